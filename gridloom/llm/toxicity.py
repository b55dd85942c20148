"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes ratios.

Features are the hashed 3- to 5-grams of a text's lower-cased UTF-8 bytes, present or
not. ``fit`` takes at most ``max_rows`` labelled rows, drawn by a hash of the id, counts
features per class (partial counts in the tasks, summed by Spark), takes each feature's
log-count ratio, keeps those that separate the classes most, and trains a logistic
regression on presence times ratio.
``score`` is one pass over the documents without a shuffle; the model it sends along is
of fixed size.

Defined results for odd input: a null text is empty, and an empty text scores what the
intercept says; labels other than 0 and 1 are ignored, as null ones are, and a document
with several labels is toxic if one of them says so; without labels of both classes every score is the share of toxic
labels (0.5 where there are none); texts of any length are taken whole, a task holding one
at once at least; an empty table gives none; extra columns are kept by ``score`` except
``score`` and ``predicted``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.llm.common import discard, pieces, settle_at

BITS = 18
GRAMS = (3, 4, 5)
MAX_ROWS = 30_000
FEATURES = 8_192
SMOOTH = 1.0
FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, by which rows are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def _grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a column of texts, per n: the buckets of the n-grams and the rows they are in."""
    low = pc.binary_join_element_wise("", pc.utf8_lower(pc.fill_null(texts, "")), "", " ").cast(pa.large_string())
    ends = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    ends = ends - ends[0]
    rows = np.repeat(np.arange(len(low), dtype=np.int32), np.diff(ends))
    h = data
    for n in range(2, max(GRAMS) + 1):
        if len(h) < 2:
            return
        h = h[:-1] * np.uint64(0x100000001B3) + data[n - 1 :]
        if n in GRAMS:
            bucket = ((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32)
            inside = rows[: len(h)] == rows[n - 1 :]
            yield bucket[inside], rows[: len(h)][inside]


def _hits(texts: pa.Array, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) where the bucket has a feature number in ``use``, not -1."""
    found = []
    for bucket, rows in _grams(texts):
        f = use[bucket]
        keep = f >= 0
        found.append(rows[keep].astype(np.int64) << 32 | f[keep])
    both = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return (both >> 32).astype(np.int64), (both & 0xFFFFFFFF).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros((2, 1 << BITS), np.int64)
    seen = np.zeros(1 << BITS, bool)
    for b in pieces(batches):
        label = b.column("toxic").to_numpy(zero_copy_only=False)
        parts = list(_grams(b.column("text")))
        if not parts:
            continue
        cuts = [np.searchsorted(rows, np.arange(b.num_rows + 1)) for _, rows in parts]
        for r in range(b.num_rows):
            for (bucket, _), cut in zip(parts, cuts, strict=True):
                seen[bucket[cut[r] : cut[r + 1]]] = True
            here = np.flatnonzero(seen)
            n[label[r], here] += 1
            seen[here] = False
    some = np.flatnonzero(n.sum(0))
    for i in range(0, len(some), 50_000):
        s = some[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(n[0, s]), pa.array(n[1, s])], ["bucket", "n0", "n1"])


@dataclass(frozen=True)
class Model:
    """``number[b]``: the feature of bucket b or -1; ``weight``: per feature; intercept."""

    number: np.ndarray
    weight: np.ndarray
    intercept: float


def drawn_labels(labels: DataFrame, max_rows: int) -> DataFrame:
    """``doc_id, toxic`` of the labels that may be learned from, ``max_rows`` at most, the
    first in order of a hash of the id."""
    usable = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    known = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return known.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(max_rows)


def log_ratios(rows: DataFrame, n: int, bad: int, features: int) -> list[Row]:
    """``bucket, ratio`` of the ``features`` n-gram buckets whose presence differs most
    between the ``bad`` toxic ones of ``n`` rows of ``text, toxic`` and the others; a
    bucket in fewer than three rows is left out. A bounded list, as features are."""
    good = n - bad
    counts = rows.mapInArrow(_count, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p1, p0 = (F.col("n1") + SMOOTH) / F.lit(bad + 2 * SMOOTH), (F.col("n0") + SMOOTH) / F.lit(good + 2 * SMOOTH)
    pooled = (F.col("n0") + F.col("n1")) / F.lit(float(n))
    z = F.abs(p1 - p0) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * F.lit(1 / bad + 1 / good))
    return counts.where("n0 + n1 >= 3").select("bucket", F.log(p1 / p0).alias("ratio"), z.alias("z")).orderBy(F.desc("z"), "bucket").limit(features).collect()


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, features: int = FEATURES) -> Model:
    spark = docs.sparkSession
    known, at_known = settle_at(drawn_labels(labels, max_rows))
    # the drawn labels are bounded, so they go to the texts and no text is shuffled
    rows, at_rows = settle_at(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic"))
    discard(spark, at_known)
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    none = np.full(1 << BITS, -1, np.int32)
    if not 0 < bad < n:
        share = min(max(bad / n, 1e-6), 1 - 1e-6) if n else 0.5
        return Model(none, np.zeros(1), float(np.log(share / (1 - share))))
    best = log_ratios(rows, n, bad, features)
    if not best:
        return Model(none, np.zeros(1), float(np.log(bad / (n - bad))))
    number, ratio = none.copy(), np.array([r["ratio"] for r in best])
    number[[r["bucket"] for r in best]] = np.arange(len(best), dtype=np.int32)

    # made as the arrays that a sparse vector consists of, so that no row meets a user function
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            row, f = _hits(b.column("text"), number)
            cut = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (f.astype(np.int32), ratio[f])]
            fixed = [pa.array(np.full(b.num_rows, x), k) for x, k in ((0, pa.int8()), (len(ratio), pa.int32()))]
            vector = pa.StructArray.from_arrays([*fixed, *lists], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.float64()), vector], ["label", "features"])

    train, at_train = settle_at(rows.mapInArrow(rows_of, StructType().add("label", "double").add("features", VectorUDT())))
    lr = LogisticRegression(maxIter=40, regParam=1e-3, standardization=False).fit(train)
    discard(spark, at_rows)
    discard(spark, at_train)
    return Model(number, np.asarray(lr.coefficients) * ratio, float(lr.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    docs = docs.drop("score", "predicted")
    schema = docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            row, f = _hits(b.column("text"), model.number)
            s = model.intercept + np.bincount(row, model.weight[f], b.num_rows)
            p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)
