"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a piece wherever it hits the block size;
each piece gives one character of the signature, and a second signature is made at
twice the block size. The block size grows with the text, so that a signature has 32 to
64 characters. Signatures are compared by edit distance, at equal block sizes or where
one is twice the other, and only where they share a run of seven characters.

``neighbours`` gives each document the next one in descending order of id: documents are
dealt into ranges of ids, and each range also gets the first document of the next one,
so order is found without gathering the table.

Defined results for odd input: a null text is empty, with the fingerprint ``3::``; equal
fingerprints have likeness 1; signatures shorter than seven characters count for less,
in proportion, as they prove little; documents that repeat an id follow each other in
order of a hash of their texts; a null id is the smallest; ids are 64-bit whole numbers; a single document
is its own next; texts of any length are taken whole, one in a task at once; an empty table
gives none; columns beside those named are not kept, so none can clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import partitions, pieces, text_or_empty

LEAST, LENGTH, RUN = 3, 64, 7
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _rolling(data: bytes) -> np.ndarray:
    """A hash of the seven bytes that end at each place (fewer at the start)."""
    c = np.zeros(len(data) + 6, np.uint32)
    c[6:] = np.frombuffer(data, np.uint8)
    p1, p2, p4, p6 = (np.uint32(0x01000193**k & 0xFFFFFFFF) for k in (1, 2, 4, 6))
    two = c[1:] + p1 * c[:-1]
    four = two[2:] + p2 * two[:-2]
    six = four[2:] + p4 * two[:-4]
    seven = six[1:] + p6 * c[:-6]
    seven ^= seven >> np.uint32(15)
    seven *= np.uint32(0x85EBCA6B)
    seven ^= seven >> np.uint32(13)
    return seven


def _signature(data: bytes, ends: np.ndarray, length: int) -> str:
    out, at = [], 0
    for e in ends[: length - 1].tolist():
        out.append(ALPHABET[zlib.crc32(data[at : e + 1]) & 63])
        at = e + 1
    if at < len(data):
        out.append(ALPHABET[zlib.crc32(data[at:]) & 63])
    return "".join(out)


def fingerprint(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    block = LEAST
    while block * LENGTH < len(data):
        block *= 2
    h = _rolling(data)
    while True:
        ends = np.flatnonzero(h % np.uint32(block) == block - 1)
        if block == LEAST or len(ends) >= LENGTH // 2:
            break
        block //= 2
    double = ends[h[ends] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(data, ends, LENGTH)}:{_signature(data, double, LENGTH // 2)}"


def _alike(a: Column, b: Column) -> Column:
    shorter = F.least(F.length(a), F.length(b))
    run = F.exists(F.sequence(F.lit(1), F.length(a) - (RUN - 1)), lambda i: F.contains(b, F.substring(a, i, F.lit(RUN))))
    near = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when(shorter == 0, 0.0).when(shorter < RUN, near * shorter / RUN).when(run, near).otherwise(0.0)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 of two fingerprints."""
    x, y = F.split(a, ":"), F.split(b, ":")
    bx, by = F.get(x, F.lit(0)).cast("long"), F.get(y, F.lit(0)).cast("long")
    x1, x2, y1, y2 = F.get(x, F.lit(1)), F.get(x, F.lit(2)), F.get(y, F.lit(1)), F.get(y, F.lit(2))
    return (
        F.when(a == b, 1.0)
        .when(bx == by, F.greatest(_alike(x1, y1), _alike(x2, y2)))
        .when(bx == 2 * by, _alike(x1, y2))
        .when(by == 2 * bx, _alike(x2, y1))
        .otherwise(0.0)
    )


def neighbours(docs: DataFrame) -> DataFrame:
    """``part, extra, doc_id, text``, partitioned and sorted such that within a part each
    row stands before the next document in descending order of id; the last row of a
    part is a copy (``extra`` 1) of the first document of the part that follows.

    Parts are ranges of ids as doubles, which keep the order of longs but not all their
    digits; within a part, and to find its first document, ids are compared as longs. Documents that
    repeat an id, or have none, follow each other in order of a hash of their texts, and where they
    fill a part they are cut by ranges of it."""
    spark = docs.sparkSession
    n = partitions(spark)
    low = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    # the bitwise complement turns the order round and never overflows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.bitwise_not(low).alias("__key"))
    rows = rows.withColumns({"__about": F.col("__key").cast("double"), "__h": F.xxhash64("text")})
    if rows.select("__key").isEmpty():
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("extra"), "doc_id", "text")
    cuts = rows.agg(F.percentile_approx("__about", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0]
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="__about", outputCol="__part").transform(rows).withColumn("__part", F.col("__part").cast("int"))
    # a row per part: no more than there are shuffle partitions, or twice as many where ids are cut
    found = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), (F.min("__key") == F.max("__key")).alias("one")).orderBy("__part").collect()
    share, first, cut = max(sum(r["n"] for r in found) / n, 1.0), 0, []
    for r in found:
        into = ceil(r["n"] / share) if r["one"] else 1
        cut.append((r["__part"], first, into))
        first += into
    if first > len(cut):
        own = F.least(F.floor((F.col("__h").cast("double") / 2.0**64 + 0.5) * F.col("__into")).cast("int"), F.col("__into") - 1)
        cut = spark.createDataFrame(cut, "__part int, __first int, __into int")
        dealt = dealt.join(F.broadcast(cut), "__part").withColumn("__part", F.col("__first") + own).drop("__first", "__into")
    heads = [(r[0], *r[1]) for r in dealt.groupBy("__part").agg(F.min(F.struct("__key", "__h"))).orderBy("__part").collect()]
    before = spark.createDataFrame([(part, key, h, heads[i - 1][0]) for i, (part, key, h) in enumerate(heads)], "__part int, __key long, __h long, __back int")
    marked = dealt.join(F.broadcast(before), ["__part", "__key", "__h"], "left")
    own = F.struct(F.col("__part").alias("part"), F.lit(0).alias("extra"))
    copy = F.struct(F.col("__back").alias("part"), F.lit(1).alias("extra"))
    spread = marked.withColumn("__to", F.explode(F.when(F.col("__back").isNotNull(), F.array(own, copy)).otherwise(F.array(own))))
    spread = spread.select("__to.part", "__to.extra", "doc_id", "text", "__key", "__h", F.col("doc_id").isNull().alias("__none"))
    return spread.repartitionByRange(n, "part").sortWithinPartitions("part", "extra", "__key", "__h", "__none", "text").drop("__key", "__h", "__none")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"


def edited_fingerprints(docs: DataFrame, share: int = 3) -> DataFrame:
    """Per document its fingerprint, that of the next document, and that of its text with
    the last ``1/share`` replaced by as much of the next document's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in pieces(batches):
            out = []
            for part, extra, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None and held[0] != part:
                    held = None
                if held is not None and held[1] == 1:
                    continue
                print_ = fingerprint(text)
                if held is not None:
                    _, _, of, before, printed = held
                    n = len(before) // share
                    edited = before[: len(before) - n] + text[:n]
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((of, len(before), sha, printed, printed if edited == before else fingerprint(edited), print_))
                held = (part, extra, doc_id, text, print_)
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in OUT.split(", ")])

    return neighbours(docs).mapInArrow(run, OUT)
