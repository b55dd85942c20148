import os

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gridloom.llm import toxicity
from gridloom.llm.common import settle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_stages_against_plain_versions(spark):
    sp = pytest.importorskip("sentencepiece")
    tok = pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out, before = docs.columns, {}, {}
    for name, stage in P.STAGES:
        before[name], docs = docs, settle(stage(spark, docs, SF))
        out[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns

    model = toxicity.fit(before["toxicity"], spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"))
    assert {r.doc_id for r in out["toxicity"].collect()} == {i for i, t in rows_of(before["toxicity"]) if brute.toxic_score(t, model) < 0.5}
    labelled = before["toxicity"].join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    clean = labelled.where("toxic = 0")
    assert clean.join(out["toxicity"], "doc_id", "left_semi").count() >= 0.98 * clean.count()
    assert labelled.where("toxic = 1").join(out["toxicity"], "doc_id", "left_semi").count() <= 0.05 * labelled.where("toxic = 1").count()

    kept = {r.doc_id for r in out["jaccard_join"].collect()}
    assert kept == {c for c, _ in brute.jaccard_classes(rows_of(before["jaccard_join"])).values()}

    want = {i: k.decode("utf-8", "ignore") for i, (_, n, _, k) in brute.repeats(rows_of(before["suffix_dedup"])).items() if not n or k}
    assert dict(rows_of(out["suffix_dedup"])) == want
    assert out["suffix_dedup"].where("n_chars <> length(text)").count() == 0

    n = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    sizes, taken, largest = {}, {}, {}
    for r in before["mixing"].groupBy("source").agg(F.sum(n).alias("n"), F.max(n).alias("most")).collect():
        sizes[r.source], largest[r.source] = r.n, r.most
    for r in out["mixing"].groupBy("source").agg(F.sum(n).alias("n")).collect():
        taken[r.source] = r.n
    for source, target in brute.targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= largest[source] / 2 + 1e-6, source
    copies = {(r.doc_id, r.text): r["count"] for r in out["mixing"].groupBy("doc_id", "text").count().collect()}
    assert max(copies.values()) <= 2 and set(copies) <= set(rows_of(before["mixing"]))

    plain = sp.SentencePieceProcessor(model_file=tok.path("piece_bpe_32k.model"))
    for r in out["sentencepiece"].collect():
        assert r.ids == plain.encode(r.text) and r.n_pieces == len(r.ids)
    assert sorted(rows_of(out["sentencepiece"])) == sorted(rows_of(before["sentencepiece"]))


ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n", None, None, 2), (4, "same words stand here and there again", "en", "a", None), (4, "same words stand here and there again", "en", "a", None),
       (None, "a row that has no id and a text of its own", "de", "b", 1), (None, None, None, None, None), (2**62, "long " * 30_000, "en", "a", 150_000)]


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_take_odd_rows(spark, name):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    mine = ("score", "copies", "size", "node", "first", "n_removed", "word", "digest", "__id")
    docs = docs.withColumns({c: F.lit("mine") for c in mine})
    stage = dict(P.STAGES)[name]
    out = settle(stage(spark, docs, SF))
    assert out.columns[: len(docs.columns)] == docs.columns
    assert out.where(" OR ".join(f"`{c}` <> 'mine' OR `{c}` IS NULL" for c in mine)).isEmpty()
    n = {"jaccard_join": 4, "suffix_dedup": 8, "sentencepiece": 8}
    assert out.count() == n.get(name, out.count())
    assert out.where("doc_id = 4").count() >= 1 or name == "toxicity"
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    assert P.run(spark, SF).count() > 0
