import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common, components, jaccard_join, sentencepiece_lattice, suffix_dedup

random.seed(5)
VOCABULARY = ["".join(random.choices("abcdefgh", k=5)) for _ in range(400)]


def prose(n):
    return " ".join(random.choices(VOCABULARY, k=n))


@pytest.fixture(scope="module")
def rows():
    base = prose(150)
    near = []
    for i in range(25):
        w = base.split()
        w[(i * 5) % 150] = f"changed{i}"
        near.append(" ".join(w))
    shared = prose(60)
    odd = [None, "", "  \n", "one two", "one two", "one  two", "a b c d e", prose(9000), "é" * 400, "x" * 5000]
    texts = [*near, *[base] * 12, *(prose(40) + " " + shared + " " + prose(40) for _ in range(15)), *(prose(80) for _ in range(20)), *odd]
    random.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_join_equals_brute_force(spark, rows, monkeypatch):
    want = brute.jaccard_classes(rows)
    for small, block in ((jaccard_join.SMALL, jaccard_join.BLOCK), (6, 4)):  # the second splits buckets and groups
        monkeypatch.setattr(jaccard_join, "SMALL", small)
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "ROWS", block)
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(frame(spark, rows)).collect()}
        assert got == want


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_join_at_other_thresholds(spark, rows, monkeypatch, threshold):
    draw = random.Random(12)
    own = lambda k: " ".join(draw.choices(VOCABULARY, k=k))
    more = []
    for both in (30, 45, 60, 90, 130):  # shared words of pairs, from far below the thresholds to above
        for _ in range(6):
            shared = own(both)
            more += [f"{shared} {own(20)}", f"{shared} {own(20)}"]
    docs = [*rows, *((1000 + i, t) for i, t in enumerate(more))]
    monkeypatch.setattr(jaccard_join, "SMALL", 6)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(frame(spark, docs), threshold).collect()}
    assert got == brute.jaccard_classes(docs, threshold)
    with pytest.raises(ValueError, match="threshold"):
        jaccard_join.join(frame(spark, docs), 0.1)


def test_join_finds_pairs_in_large_buckets(spark, monkeypatch):
    """Pairs of 0.8 that share nothing but a passage, which many others hold too."""
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    draw, n = random.Random(8), iter(range(10**9))
    own = lambda k: " ".join(f"{draw.choice(VOCABULARY)}{next(n)}" for _ in range(k))
    texts = []
    for _ in range(150):
        passage = own(100)
        texts += [f"{passage} {own(12)}" for _ in range(2)] + [f"{own(75)} {passage} {own(75)}" for _ in range(8)]
    got = {r.doc_id: r.n_links for r in jaccard_join.join(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == [1, 1, *[0] * 8] * 150


def test_a_split_sends_every_row_on(spark):
    rows = spark.range(20_000, numPartitions=1).select(F.col("id").alias("bucket"), F.col("id").alias("node"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("s"))
    rows = rows.select("bucket", "node", F.concat(*["s"] * 4).alias("sketch"))
    for level, trees in ((0, 3), (1, 3)):
        assert jaccard_join._split(rows, level, trees).count() == 20_000 * (trees if level == 0 else 1)


@pytest.mark.parametrize("n", [9, 45, 450])
def test_pairs_meet_in_a_tree_at_every_depth(n):
    """2,000 pairs of sets of similarity 0.8, with only their tree buckets to meet in."""
    import numpy as np

    draw, trees = np.random.default_rng(n), jaccard_join._trees(0.8, (1 - jaccard_join.RECALL) / 2)
    ids = draw.integers(0, 2**64, (2000, n * 10 // 9), dtype=np.uint64)
    both, own = n * 8 // 9, (n - n * 8 // 9)
    a, b = (np.stack([np.frombuffer(jaccard_join._sketch(np.sort(np.append(r[:both], o))), np.uint8) for r, o in zip(ids, part, strict=True)]) for part in (ids[:, both : both + own], ids[:, both + own : both + 2 * own]))
    met = np.zeros(2000, int)
    for t in range(trees):
        at = [jaccard_join.mix(np.full(2000, t, np.uint64), 31)] * 2
        same = np.ones(2000, bool)
        for level in range(jaccard_join.DEPTH):
            at = [jaccard_join._children(s, x, level) for s, x in zip((a, b), at, strict=True)]
            same &= at[0] == at[1]
            met = np.maximum(met, np.where(same, level + 1, 0))
    for depth in range(1, jaccard_join.DEPTH + 1):
        print(n, depth, (met >= depth).mean())
    assert (met == jaccard_join.DEPTH).mean() > 0.998


def test_join_of_repeated_and_unnamed_rows(spark):
    t = prose(60)
    df = frame(spark, [(1, t), (1, t), (None, t), (None, t + " end"), (None, None), (2, prose(50)), (2, prose(50))]).withColumns({"node": F.lit("mine"), "first": F.lit(0)})
    kept = jaccard_join.keep_first(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "2", "None"]
    assert all(r.node == "mine" for r in kept)
    assert jaccard_join.join(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(1000, 1001), (7, 7)], "a long, b long"))
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1001] == 1000
    with pytest.raises(RuntimeError, match="not found"):
        components.components(edges, rounds=2)


@pytest.mark.parametrize("many", [suffix_dedup.MANY, 2])
def test_suffix_dedup_equals_brute_force(spark, rows, many):
    want = {i: (a, b, c, hashlib.sha256(k).hexdigest()) for i, (a, b, c, k) in brute.repeats(rows).items()}
    out = suffix_dedup.remove_repeats(frame(spark, rows).withColumn("n_bytes", F.lit("old")), many=many).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == want
    assert sum(r.n_removed for r in out) > 0
    assert next(r.text for r in out if r.doc_id == min(i for i, t in rows if t and len(t) > 100)) == next(t for _, t in rows if t and len(t) > 100)


def test_suffix_dedup_orders_by_id_and_takes_repeats(spark):
    t = prose(80)
    out = {(r.doc_id, r.kept_sha256): r.n_removed for r in suffix_dedup.remove_repeats(frame(spark, [(5, t), (3, t), (3, t), (4, "short")])).collect()}
    whole = hashlib.sha256(t.encode()).hexdigest()
    assert out[(3, whole)] == 0 and out[(5, hashlib.sha256(b"").hexdigest())] == len(t)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_one_file_is_taken_in_groups(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "GROUP", 20)
    frame(spark, rows).coalesce(1).write.parquet(f"file://{tmp_path}/one")
    docs = spark.read.parquet(f"file://{tmp_path}/one").select("doc_id", "text")
    assert max(r["count"] for r in common.from_files(docs).groupBy("__file").count().collect()) == 20
    assert common.from_files(docs).inputFiles() == docs.inputFiles()
    want = {i: (b, hashlib.sha256(k).hexdigest()) for i, (_, b, _, k) in brute.repeats(rows).items()}
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()} == want
    model = sentencepiece_lattice.Model({p: (i + 256, -1.0) for i, p in enumerate("abcdefgh▁")}, [bytes([i]) for i in range(256)] + [p.replace("▁", " ").encode() for p in "abcdefgh▁"], 0, True)
    read = {r.doc_id: r.decoded for r in sentencepiece_lattice.encode(docs, model, round_trip=True).collect()}
    assert all(read[i] == t for i, t in rows)


def test_anchors_of_parts_are_those_of_the_whole():
    import numpy as np

    draw = np.random.default_rng(4)
    data = draw.integers(97, 100, 9000).astype(np.uint8)
    ends = np.array([0, 0, 50, 149, 250, 4000, 4000, 9000])
    want = suffix_dedup.anchors(data, ends, 100)
    hashes = suffix_dedup.context_hashes(data, want[2], want[3], want[0])
    assert len(want[0]) > 100
    for part in (1, 101, 4096):
        got = suffix_dedup.anchors(data, ends, 100, part=part)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))
        assert (suffix_dedup.context_hashes(data, got[2], got[3], got[0], part) == hashes).all()


def test_seen_before_against_plain():
    import numpy as np

    data = np.frombuffer(b"abracadabra-abracadabra", np.uint8)
    zero = np.zeros(len(data), np.int64)
    got = suffix_dedup.seen_before(data, zero, np.arange(len(data)), np.arange(len(data)) + 4 <= len(data), 4)
    want = [data[:i].tobytes().find(data[i : i + 4].tobytes()) >= 0 or data[: i + 3].tobytes().find(data[i : i + 4].tobytes()) >= 0 for i in range(len(data) - 3)]
    assert got[: len(want)].tolist() == want and not got[len(want) :].any()
