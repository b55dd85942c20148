"""Target-distribution importance resampling by external sort-count.

A document's features are its normal words and pairs of neighbouring ones, each hashed to
one of ``buckets``. What the texts say is written down once:

1. ``packed`` writes each document's buckets as packed 16-bit numbers. A column of them is a
   stream with the documents' offsets, in Arrow as in Parquet, so it is read back as one array;
2. ``bucket_counts`` sorts the stream a batch at a time and counts its runs; a task sends a row
   for each bucket at most, and Spark adds them up;
3. ``gains`` are the buckets' scaled log ratios of target to source, a table of fixed size;
4. ``scored`` gathers the gains along the stream, adds them up between the offsets
   (``np.add.reduceat``), and adds a Gumbel number that a hash of the id gives;
5. ``drawn`` numbers the documents in order of score: they are dealt by ranges of it, sorted in
   their part, and a part's documents count on from those of the parts before.

The texts are read once and never shuffled; the streams (two bytes a feature) and rows of some
numbers a document are all that is written, and the numbers all that is shuffled. The target's
texts go the same way, so they may be as many as they like.

Defined results for odd input: a null or wordless text has no features and weight 0, and is never drawn
where ``least_words`` is above 0; a null doc_id is hashed as no digits and comes first among equals;
rows that repeat an id are drawn each, equal ones by their number of features, then in any order, as they
are alike; a text is taken whole, one at once at least, at some 15 times its size, and may have a
billion features; an empty table gives none, and an empty target has no counts; other columns are left out by
``importance`` and kept by ``resample``, but for ``__digest`` and ``__id``, which it drops, and those it adds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, partitions, pieces, settle, settle_at
from gridloom.llm.normal_words import crc32, crc32_pairs, word_spans

BUCKETS, SEED = 10_000, 7
SHARE, LEAST_WORDS = (25, 100), 20
PACKED = "doc_id long, digest long, n_words long, stream binary"


def packed(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, digest, n_words, stream``: the buckets of the features, 16 bits each."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("there are 1 to 65536 buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            data, _, start, stop, bounds = word_spans(b.column("text"))
            n = np.diff(bounds)
            # per row n words and n - 1 pairs, in turn: where the row begins, twice its words less the rows with any
            begin = np.append(0, np.cumsum(np.maximum(2 * n - 1, 0)))
            if begin[-1] >= 1 << 30:
                raise ValueError("a text has over a billion features")
            stream = np.zeros(begin[-1], "<u2")
            if len(start):
                crc = crc32(data, start, stop)
                row = np.repeat(np.arange(len(n)), n)
                place = begin[:-1][row] + 2 * (np.arange(len(start)) - bounds[:-1][row])
                stream[place] = crc % np.uint32(buckets)
                inside = row[1:] == row[:-1]
                stream[place[:-1][inside] + 1] = crc32_pairs(data, start, stop, crc)[inside] % np.uint32(buckets)
            offsets = pa.py_buffer((2 * begin).astype(np.int32))
            streams = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(stream)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(n.astype(np.int64)), streams], ["doc_id", "digest", "n_words", "stream"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text").mapInArrow(run, PACKED)


def _stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and the rows' bounds in them."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", "<u2")[ends[0] // 2 : ends[-1] // 2], (ends - ends[0]) // 2


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is in the streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in pieces(batches, "stream", 8 << 20):
            s = np.sort(_stream(b.column("stream"))[0], kind="stable")
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
            total[s[first]] += np.diff(np.append(first, len(s)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in streams.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the log of the target's share over the source's, both of counts
    with one added, rounded down."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    ratio = lambda a, b: (b + 1.0) * (s + n) / ((a + 1.0) * (t + n))
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def scored(streams: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, digest, n_words, n_features, weight, score``."""

    def noise(doc_id: int | None) -> int:
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "stream", 8 << 20):
            stream, ends = _stream(b.column("stream"))
            n, weight = np.diff(ends).astype(np.int64), np.zeros(b.num_rows, np.int64)
            some = n > 0
            if some.any():
                weight[some] = np.add.reduceat(gain[stream], ends[:-1][some]) // n[some]
            score = weight + np.array([noise(i) for i in b.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "digest", "n_words")), pa.array(n), pa.array(weight), pa.array(score)], ["doc_id", "digest", "n_words", "n_features", "weight", "score"])

    return streams.mapInArrow(run, "doc_id long, digest long, n_words long, n_features long, weight long, score long")


def drawn(scores: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scores`` with ``rank``: 1, 2, 3 ... for the share of the documents of enough words that
    score highest, NULL for the others."""
    spark = scores.sparkSession
    scores, at_scores = settle_at(scores.withColumn("__at", F.monotonically_increasing_id()))
    enough = scores.where(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("__at")]
    dealt = enough.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt, at_dealt = settle_at(dealt.withColumn("__place", F.monotonically_increasing_id()))
    # a number of this kind is the part's, above 33 bits of the row's in it
    sizes = sorted((r["p"], r["n"]) for r in dealt.groupBy(F.shiftright("__place", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    offsets = spark.createDataFrame(offsets, "__p long, __before long")  # a row for each partition
    numbered = dealt.join(F.broadcast(offsets), F.shiftright("__place", 33) == F.col("__p"))
    rank = F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1
    numbered = numbered.withColumn("rank", F.when(rank <= before * share[0] // share[1], rank))
    rest = scores.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = settle(numbered.select(rest.columns).unionByName(rest).drop("__at"))
    for path in (at_scores, at_dealt):
        discard(spark, path)
    return out


def importance(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """A row per document: ``doc_id, digest, n_words, n_features, weight, score, rank``.
    ``target``: rows with a ``text``."""
    spark = docs.sparkSession
    streams, at_streams = settle_at(packed(docs, buckets), compression="zstd")
    wanted, at_wanted = settle_at(packed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets), compression="zstd")
    gain = gains(bucket_counts(streams, buckets), bucket_counts(wanted, buckets))
    out = drawn(scored(streams, gain, seed), share, least_words)
    for path in (at_streams, at_wanted):
        discard(spark, path)
    return out


def resample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents with ``weight``, ``score`` and ``rank``; rows that repeat id and text
    are taken together, where one of them is drawn, with the rank of the first."""
    docs = docs.drop("weight", "score", "rank", "__digest", "__id")
    chosen = importance(docs, target, **how).where("rank IS NOT NULL")
    first = chosen.groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(*[F.min(c).alias(c) for c in ("weight", "score", "rank")])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__digest"))
    return docs.join(first, same).drop("__digest", "__id")
