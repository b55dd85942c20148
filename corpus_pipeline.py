"""From raw documents to piece ids: five stages over the operators of ``gridloom.llm``.

Each stage takes the documents that the one before has written and returns those it
keeps, in the columns of ``documents``; the last adds ``ids`` and ``n_pieces``. Other columns
are put aside meanwhile and kept, also where a stage uses their names, but for ``ids`` and
``n_pieces``, which the last replaces.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import jaccard_join, mixing, sentencepiece_lattice, suffix_dedup, toxicity
from gridloom.llm.common import load, settle


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ASIDE = "__own_"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def others_aside(stage: Stage) -> Stage:
    """The stage over documents whose other columns have names that no operator uses."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        out = stage(spark, docs.withColumnsRenamed({c: ASIDE + c for c in docs.columns if c not in COLUMNS}), sf_dir)
        back = {c: c.removeprefix(ASIDE) for c in out.columns if c.startswith(ASIDE)}
        return out.drop(*(c for c, name in back.items() if name in out.columns)).withColumnsRenamed(back)

    return run


@others_aside
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, calls toxic go.

    Null and empty texts score what the intercept says; repeated rows, and such as share an
    id, are judged each; a text of any length is judged whole; an empty table gives none.
    """
    model = toxicity.fit(docs, load(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


@others_aside
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the first stays.

    First is the least id, then the least digest of the text; a row without an id comes last.
    Wordless texts, null ones among them, are copies of each other, and so are repeated
    rows: one stays. An empty table gives none.
    """
    return jaccard_join.keep_first(docs)


@others_aside
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What repeats 100 bytes of an earlier place is cut; a document of which nothing is
    left goes.

    Null and short texts stay as they are; a row without an id comes first; rows that repeat
    both id and text are one document, and each keeps what that keeps. ``n_chars`` is counted
    anew where something was cut. An empty table gives none.
    """
    cut = suffix_dedup.remove_repeats(docs).where("n_removed = 0 OR text <> ''")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


@others_aside
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes.

    Wordless texts, null ones among them, are not taken; a null source is one of its own, the
    last; rows that repeat an id are taken or left together. An empty table gives none.
    """
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(docs.columns)


@others_aside
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each text: ``ids`` and ``n_pieces``.

    A null text has null ids and no pieces, an empty one an empty list; repeated rows are
    encoded each; a text of any length is encoded whole. An empty table gives none.
    """
    encoded = sentencepiece_lattice.encode(docs, sentencepiece_lattice.load_model())
    return encoded.withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Classifier, join and suffix arrays are beyond SQL; a test holds each stage against a
#: plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
