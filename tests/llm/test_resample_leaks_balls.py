"""Operators 11 to 13 against plain versions and SQL, and over odd rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.llm import ball_kmeans, decontaminate, importance_resampling, normal_words

SF = "/root/testdata/sf0.001"
WORDS = re.compile(normal_words.PATTERN)
draw = random.Random(11)
VOCABULARY = ["".join(draw.choices("abcdeÄéß9", k=draw.randint(1, 6))).lower() for _ in range(60)]


def prose(n):
    return " ".join(draw.choices(VOCABULARY, k=n))


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORDS.findall(low)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_decontaminate", "op13_ball_kmeans"])
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF)
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want = c.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[k] for k in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_checksums_of_words_and_pairs():
    texts = ["Hello Wörld a", None, "", f"{'x' * 255} y {'z' * 256} {'Q' * 900} b", "ÀB c-d_e", "one", "日本 語"]
    data, _, start, stop, bounds = normal_words.word_spans(pa.array(texts))
    found = [bytes(data[i:j]) for i, j in zip(start, stop, strict=True)]
    assert found == [w.encode() for t in texts for w in words(t)]
    assert np.diff(bounds).tolist() == [len(words(t)) for t in texts]
    crc = normal_words.crc32(data, start, stop)
    assert crc.tolist() == [zlib.crc32(w) for w in found]
    assert normal_words.crc32_pairs(data, start, stop, crc).tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(found, found[1:], strict=False)]
    hashes = normal_words.word_hashes(data, start, stop)
    assert len(set(hashes.tolist())) == len(set(found))


def plain_importance(docs, target, share, least):
    def features(t):
        w = words(t)
        return [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    total = lambda c: sum(c.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total(s) / ((s[b] + 1) * total(t))))
    out = []
    for i, x in docs:
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x))))
    enough = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(enough[: len(enough) * share[0] // share[1]])]
    rest = [(*r[:4], None) for r in enough[len(drawn) :] + [r for r in out if r[4] < least]]
    return drawn + rest


def test_importance_equals_a_plain_version(spark):
    texts = [*(prose(draw.randint(1, 80)) for _ in range(150)), None, "", " - ", prose(30_000), "ÄÖ" * 500]
    docs = [*enumerate(texts), (7, "again " + prose(30)), (7, texts[7]), (None, prose(40)), (None, prose(40)), *[(500, prose(50))] * 9]
    target = [prose(50).replace("a", "b"), None, "x y z"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("digest", F.lit("mine")).repartition(5)
    to = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_resampling.importance(df, to).collect()
    assert sorted(map(str, ((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got))) == sorted(map(str, plain_importance(docs, target, (25, 100), 20)))
    kept = importance_resampling.resample(df.withColumn("rank", F.lit("old")), to)
    assert set(kept.columns) == {"doc_id", "text", "digest", "weight", "score", "rank"}
    ranks = {(r.doc_id, r.rank) for r in kept.collect()}
    assert len({k for _, k in ranks}) == len(ranks) and min(k for _, k in ranks) == 1
    assert importance_resampling.importance(df.limit(0), to).count() == 0
    assert importance_resampling.importance(df, to.limit(0)).count() == len(docs)


def test_index_finds_and_locates_like_a_scan():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, v = int(rng.integers(1, 60)), int(rng.integers(1, 4))
        text = np.append(rng.integers(0, v + 1, n), 0)
        index = decontaminate.FMIndex(text, rate=int(rng.integers(1, 5)))
        for length in (1, 2, 3):
            patterns = np.unique(rng.integers(1, v + 3, (20, length)), axis=0)
            for p, lo, hi in zip(patterns, *index.search(patterns), strict=True):
                want = [i for i in range(len(text) - length + 1) if (text[i : i + length] == p).all()]
                assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def plain_leaks(docs, items, window=10):
    out = []
    for i, x in docs:
        w, hit, names = words(x), set(), set()
        for item, t in items:
            b = words(t)
            n = min(len(b), window)
            wanted = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1 if wanted else 0):
                if tuple(w[k : k + n]) in wanted:
                    hit |= set(range(k, k + n))
                    names.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), sorted(names), sorted(hit)))
    return out


@pytest.mark.parametrize(("shard", "block"), [(decontaminate.SHARD, decontaminate.BLOCK), (3000, 100)])
def test_leaks_equal_a_plain_version(spark, monkeypatch, shard, block):
    monkeypatch.setattr(decontaminate, "SHARD", shard)
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    long = prose(300)
    items = [(1, prose(40)), (2, prose(10)), (3, "alpha beta"), (4, "Gamma"), (5, None), (6, " . "), (7, long), (7, prose(15)), (None, prose(12)), (8, prose(11)), (9, " ".join(long.split()[100:120])), (9, "alpha beta")]
    text = dict((i, t) for i, t in items if i not in (7, 9))
    docs = [
        (1, f"{prose(20)}. {text[1].upper().replace('Ä', 'ä')}! {prose(30)}"), (2, f"{prose(5)} {' '.join(text[1].split()[5:16])} {prose(5)}"), (3, " ".join(text[1].split()[:9])), (4, text[2] + " " + text[2]),
        (5, "so ALPHA, beta gamma"), (6, None), (7, ""), (8, "--"), (9, f"{long} {prose(8000)} {long}"), (9, prose(10)), (None, text[None]), *[(20, text[8])] * 7, (21, "alpha"), (22, "beta alpha"), *((100 + k, prose(60)) for k in range(40)),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(0)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], [k for s in r.spans for k in range(s.start, s.stop)]) for r in decontaminate.find(df, bench).collect()]
    want = plain_leaks(docs, items)
    assert sorted(map(str, got)) == sorted(map(str, want))
    # without the spans nothing is left of them
    cut = {(r.doc_id, r.n_words): (r.text, r.n_hit) for r in decontaminate.find(df, bench, cut=True).collect()}
    assert all(len(words(t)) == n - hit for (_, n), (t, hit) in cut.items())
    assert cut[5, 4][0] == "so "
    assert decontaminate.find(df.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 and r["items"] == [] for r in decontaminate.find(df, bench.limit(0)).collect())


def plain_kmeans(rows, k=16, rounds=3):
    x = [(i, np.array([math.floor(64 * float(c)) for c in v])) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(x, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist()))
    c = np.array([v for _, v in order[:k]])
    points = np.array([v for _, v in x])
    nearest = lambda: ((points[:, None, :] - c[None]) ** 2).sum(2)
    for _ in range(rounds):
        at = nearest().argmin(1)
        for j in range(len(c)):
            if (at == j).any():
                c[j] = points[at == j].sum(0) // (at == j).sum()
    d = nearest()
    return [(i, int(a), int(m)) for (i, _), a, m in zip(x, d.argmin(1), d.min(1), strict=True)]


def test_balls_equal_plain_kmeans(spark, monkeypatch):
    monkeypatch.setattr(ball_kmeans, "ROWS", 100)
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 2, (9, 64))
    rows = [(i, (middles[i % 9] + rng.normal(0, 0.2 + i % 3, 64)).tolist()) for i in range(400)]
    rows += [(i + 400, [float(i % 3)] * 64) for i in range(30)] + [(1, rows[1][1]), (None, [0.5] * 64), *[(900, [0.25] * 64)] * 5]
    odd = [(901, None), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [math.nan] * 64), (905, [math.inf] * 64), (906, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("mine")).repartition(4)
    made, centroids = ball_kmeans.cluster(df)
    assert sorted(map(str, ((r.vec_id, r.cluster, r.distance) for r in made.collect()))) == sorted(map(str, plain_kmeans(rows)))
    assert ball_kmeans.summary(made, centroids).count() == len(rows)
    few, c = ball_kmeans.cluster(df.where("vec_id < 3"))
    assert len(c) == 4 and few.count() == 4
    none, c = ball_kmeans.cluster(df.limit(0))
    assert len(c) == 0 and ball_kmeans.summary(none, c).count() == 0


def test_balls_compare_less_and_alike():
    rng = np.random.default_rng(5)
    middles = rng.integers(-2000, 2000, (40, 64))
    x = (middles[rng.integers(0, 40, 5000)] + rng.integers(-60, 60, (5000, 64))).astype(np.int64)
    start = ball_kmeans.Balls(middles.astype(np.int64), np.empty(0), [], [])
    at, d, n = ball_kmeans.assign(x, None, start)
    reach = np.full(40, -1, np.int64)
    np.maximum.at(reach, at, d)
    moved = np.array([x[at == i].sum(0) // max((at == i).sum(), 1) for i in range(40)])
    balls = start.moved(moved, reach)
    again, best, few = ball_kmeans.assign(x, at, balls)
    all_ = ((x[:, None, :] - moved[None]) ** 2).sum(2)
    assert (again == all_.argmin(1)).all() and (best == all_.min(1)).all()
    assert n == 5000 * 40 and few < 5000 * 2


def test_far_components_are_held(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]
    made, _ = ball_kmeans.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2)
    assert {r.vec_id for r in made.where("distance >= 0").collect()} == {1, 2, 3}
