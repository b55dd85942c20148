"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.scratch import discard as discard
from gridloom.sources.scratch import scratch

#: A word is a run of characters other than ASCII white space.
ASCII_SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a file whose share a task holds at once.
GROUP = 4_096
#: Bytes of a row group of what tasks look up by file.
ROW_GROUP = 2 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the application's, which driver and executors share."""
    return scratch(spark)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut,
    and a lost executor costs no recomputation of what came before."""
    return settle_at(df)[0]


def settle_at(df: DataFrame, compression: str = "snappy") -> tuple[DataFrame, str]:
    """``settle`` with the folder, for ``discard``."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``size`` bytes of text, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(n) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield b.slice(i, j - i)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column (null: empty) in a row, and the rows' bounds in them."""
    col = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def from_files(docs: DataFrame) -> DataFrame:
    """``docs``, written to Parquet files first where not all rows come from some, with
    ``__file``, a number for the file and the ``GROUP`` rows of it that a row is in. Rows are
    counted in the file, so the number is the same however a scan splits it."""
    if not docs.where(F.input_file_name() == "").isEmpty():
        docs = settle(docs)
    try:
        return _numbered(docs)
    except AnalysisException:  # no rows are counted in other formats
        return _numbered(settle(docs))


def _numbered(docs: DataFrame) -> DataFrame:
    at = docs.metadataColumn("_metadata")
    return docs.withColumn("__file", F.xxhash64(at["file_path"], (at["row_index"] / GROUP).cast("long")))


def by_file(rows: DataFrame, *order: str) -> str:
    """Writes ``rows`` so that a task that reads documents in place finds what concerns a
    ``file`` without a shuffle of their texts; returns the folder. There are as many parts as
    shuffle partitions, a file's number says which is its, and parts are sorted by file, so
    that a reader takes the row groups that have it by their statistics."""
    spark = rows.sparkSession
    n = partitions(spark)
    folder = f"{shared_dir(spark)}/of-{n}"
    part = F.pmod(F.col("file"), F.lit(n)).cast("int")
    dealt = rows.withColumn("part", part).repartition(n, "part").sortWithinPartitions("part", "file", *order)
    dealt.write.option("parquet.block.size", ROW_GROUP).partitionBy("part").parquet(folder)
    return folder


def rows_of_file(folder: str, file: int, schema: pa.Schema) -> pa.Table:
    """In a task: what ``by_file`` wrote for one file."""
    n = int(folder.rpartition("/of-")[2])
    own = pa.schema([*schema, ("file", pa.int64())])
    return rows_of_folder(f"{folder}/part={file % n}", own, pc.field("file") == file).select(schema.names)


def rows_of_folder(folder: str, schema: pa.Schema, where: pc.Expression | None = None) -> pa.Table:
    """In a task: the rows of a folder's Parquet files, none if it is not there."""
    from pyarrow import dataset, fs

    store, path = fs.FileSystem.from_uri(folder)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return schema.empty_table()
    return dataset.dataset(path, filesystem=store, format="parquet", schema=schema).to_table(filter=where, use_threads=False)


def same_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batches cut where ``__file`` changes."""
    for b in batches:
        files = b.column("__file").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield int(files[i]), b.slice(i, j - i)
