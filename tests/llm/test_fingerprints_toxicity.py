import os
import random

import brute
import pytest
from pyspark.sql import functions as F

from gridloom.llm import fingerprints, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_fingerprints_of_odd_texts():
    assert fingerprints.fingerprint("") == "3::"
    long = "word " * 200_000
    assert fingerprints.fingerprint(long) == fingerprints.fingerprint("word " * 200_000)
    assert max(map(len, fingerprints.fingerprint(long).split(":")[1:])) <= fingerprints.LENGTH


def test_likeness_of_copies_edits_and_strangers(spark):
    random.seed(2)
    text = lambda n: " ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(n))
    a, b = text(400), text(400)
    pairs = [(a, a), (a, a[:1000] + "inserted words here " + a[1000:]), (a, b), ("", ""), ("", a), (a, a + a)]
    df = spark.createDataFrame([(fingerprints.fingerprint(x), fingerprints.fingerprint(y)) for x, y in pairs], "x string, y string")
    same, near, far, empty, none, double = (r[0] for r in df.select(fingerprints.likeness(F.col("x"), F.col("y"))).collect())
    assert same == 1.0 and empty == 1.0 and near > 0.85 and far == 0.0 and none == 0.0 and 0 <= double <= 1


@pytest.mark.parametrize("n", [0, 1, 2, 57])
def test_neighbours_against_plain(spark, n):
    rows = [(i * 3, None if i == 5 else "" if i == 6 else f"text number {i} " * (i + 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit("clash"))
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(df).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == n
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % n][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_fingerprint == fingerprints.fingerprint(edited)
        assert got[i].fingerprint == fingerprints.fingerprint(t) and got[i].next_fingerprint == fingerprints.fingerprint(following)


def test_fingerprints_and_likeness_against_plain(spark):
    draw = random.Random(7)
    texts = ["", "a", "abcdefg", "ab" * 300, "é漢🙂" * 40] + ["".join(draw.choices("abcde fghij", k=draw.choice([30, 200, 900, 5000]))) for _ in range(12)]
    texts += [t[: len(t) // 2] + "changed" + t[len(t) // 2 :] for t in texts[5:]] + [t * 2 for t in texts[5:9]]
    made = [fingerprints.fingerprint(t) for t in texts]
    assert made == [brute.fingerprint(t) for t in texts]
    pairs = [(a, b) for a in made for b in made]
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", fingerprints.likeness(F.col("x"), F.col("y")).alias("s")).collect()
    assert [r.s for r in got] == pytest.approx([brute.likeness(r.x, r.y) for r in got])
    assert len({r.s for r in got}) > 20


def test_neighbours_of_ids_that_doubles_cannot_tell_apart(spark):
    ids = [2**60 + i for i in range(9)] + [-(2**63), -(2**63) + 1, 2**63 - 1, 2**63 - 2, 0, None]
    rows = [(i, f"text {(7 * k) % 15} " * 30) for k, i in enumerate(ids)]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, 0 if r[0] is None else -r[0]))
    for k, (i, _) in enumerate(order):
        assert got[i].next_fingerprint == brute.fingerprint(order[(k + 1) % len(order)][1]), i


def test_many_rows_without_an_id_are_cut(spark):
    rows = [(None, f"text {i} " * (i % 7 + 9)) for i in range(600)] + [(i, f"named {i} " * 9) for i in range(300)] + [(-5, f"same {i} " * 8) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parts = fingerprints.neighbours(df).where("extra = 0").groupBy("part").count().collect()
    assert sum(r["count"] for r in parts) == 1200 and max(r["count"] for r in parts) < 600
    order = [r.text for r in df.orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text")).collect()]
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    got = fingerprints.edited_fingerprints(df).collect()
    want = sorted((str(i), fingerprints.fingerprint(t), fingerprints.fingerprint(after[t])) for i, t in rows)
    assert sorted((str(r.doc_id), r.fingerprint, r.next_fingerprint) for r in got) == want


def test_neighbours_of_repeated_and_unnamed_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (None, "z")], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(df).count() == 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    scored = queries.op7_toxicity(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    right, n = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.9


def labelled(spark):
    rows = [(i, f"you idiot number {i}" if i % 3 == 0 else f"a kind word number {i}") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")


def test_scores_of_odd_texts(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels.unionByName(labels).unionByName(spark.createDataFrame([(1, None)], "doc_id long, toxic int")))
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "IDIOT " * 20_000), (3, "a kind word"), (None, "you idiot")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert got[0].score == got[1].score and all(0 <= r.score <= 1 for r in got.values())
    assert got[None].predicted == 1 and got[3].predicted == 0
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_ratios_and_scores_against_plain(spark):
    docs, labels = labelled(spark)
    rows = [(r.text, r.toxic) for r in docs.join(labels, "doc_id").collect()]
    df = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    got = {r["bucket"]: (r["ratio"], r["z"]) for r in toxicity.log_ratios(df, len(rows), sum(t for _, t in rows), 10**6)}
    want = brute.toxic_ratios(rows)
    assert set(got) == set(want) and all(got[b] == pytest.approx(want[b]) for b in want)
    model = toxicity.fit(docs, labels)
    odd = [(0, None), (1, ""), (2, "IDIOT É"), (3, "a kind word number 9"), (4, "x" * 50)]
    for r in toxicity.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect():
        assert r.score == pytest.approx(brute.toxic_score(odd[r.doc_id][1], model)) and r.predicted == (r.score >= 0.5)


def test_labels_other_than_0_and_1_are_ignored(spark):
    docs, labels = labelled(spark)
    odd = labels.unionByName(spark.createDataFrame([(i, 7 - i % 9) for i in range(50) if 7 - i % 9 not in (0, 1)], "doc_id long, toxic int"))
    a, b = (toxicity.fit(docs, x) for x in (labels, odd))
    assert a.intercept == pytest.approx(b.intercept) and a.weight.tolist() == pytest.approx(b.weight.tolist())


def test_fit_without_both_classes(spark):
    docs, labels = labelled(spark)
    for some, want in ((labels.where("toxic = 0"), 0), (labels.where("toxic = 1"), 1), (labels.limit(0), 1)):
        model = toxicity.fit(docs, some)
        assert {r.predicted for r in toxicity.score(docs.limit(5), model).collect()} == {want}


def test_held_out_labels_are_not_learned(spark):
    docs, labels = labelled(spark)
    turned = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ([r.score for r in toxicity.score(docs.orderBy("doc_id"), toxicity.fit(docs, x)).collect()] for x in (labels, turned))
    assert a == pytest.approx(b)
