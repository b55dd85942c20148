"""Fingerprints of tables and of source files, to tell whether a stage's inputs have changed."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(value: object) -> str:
    """Of a JSON value, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def table_fingerprint(df: DataFrame) -> str:
    """Equal for tables of the same columns and rows, in whatever order of both: the number of rows with
    the sum and the exclusive or of their hashes, one aggregation without a shuffle of rows. A hash
    skips NULLs, so it is told which there are."""
    columns = sorted(df.columns)
    h = F.xxhash64(*[F.col(f"`{c}`") for c in columns], *[F.col(f"`{c}`").isNull() for c in columns])
    found = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return digest([sorted(df.dtypes), *map(str, found)])


def files_fingerprint(spark: SparkSession, path: str, variable: str | None = None) -> str:
    """Of the listing of a folder: each file's path in it, size and time of change; with a
    ``variable`` only the files of that partition and such as are in none. Nothing is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    if variable is not None:
        of = F.upper(F.regexp_extract("path", "/variable=([^/]*)/", 1))
        listed = listed.where(of.isin("", variable.upper()))
    return table_fingerprint(listed.withColumn("path", F.regexp_replace("path", "^[a-z0-9]+:/*", "/")))
