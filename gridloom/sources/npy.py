"""Cubes kept as NumPy arrays: a Spark data source over ``.npy`` files, and a sink.

An array has the axes time, latitude and longitude, a mask the last two. It is a file, or a folder of
files that each hold some steps, named by the first of them. A partition of a scan is a byte range
of whole steps of one file, and filters on ``time_idx`` cut the ranges before anything is read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "time_idx int, lat_idx int, lon_idx int, pixel_id long, value double"
#: Bytes of a partition, about.
RANGE = 32 << 20


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def header(store, path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, kind of numbers and the byte that data begin at."""
    with store.open_input_file(path) as f:
        head = io.BytesIO(f.read(min(f.size(), 1 << 16)))
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if fortran or dtype.hasobject:
        raise ValueError(f"{path} is not a plain array in row order")
    return shape, dtype, head.tell()


def files(path: str) -> list[tuple[int, str, tuple[int, ...], np.dtype, int]]:
    """First step, path, shape, kind and data's place of each file; all must be alike."""
    from pyarrow import fs

    store, at = _open(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    listed = [at] if info.type == fs.FileType.File else sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if x.path.endswith(".npy"))
    if not listed:
        raise FileNotFoundError(f"{path}/*.npy")
    out = []
    for p in listed:
        shape, dtype, begin = header(store, p)
        if len(shape) not in (2, 3):
            raise ValueError(f"{p} has {len(shape)} axes; 2 or 3 are expected")
        first = int(p.rpartition("/")[2].removesuffix(".npy").rpartition("t")[2]) if info.type != fs.FileType.File else 0
        out.append((first, p, shape if len(shape) == 3 else (1, *shape), dtype, begin))
    if len({(f[2][1:], f[3]) for f in out}) > 1:
        raise ValueError(f"the arrays of {path} have other shapes")
    return sorted(out)


class Steps(InputPartition):
    """Steps ``lo`` to ``hi`` of a file whose first is ``first``."""

    def __init__(self, path: str, first: int, lo: int, hi: int, begin: int, shape: tuple[int, ...], dtype: str) -> None:
        super().__init__(path)
        self.path, self.first, self.lo, self.hi, self.begin, self.shape, self.dtype = path, first, lo, hi, begin, shape, dtype


class NpyReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size, self.lo, self.hi, self.only = path, size, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of ``time_idx`` cut the steps; Spark still tests every filter itself."""
        for f in filters:
            if getattr(f, "attribute", None) == ("time_idx",):
                if isinstance(f, EqualTo):
                    self._bound(f.value, f.value)
                elif isinstance(f, In):
                    self._bound(min(f.value, default=0), max(f.value, default=-1))
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self._bound(f.value + isinstance(f, GreaterThan), None)
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self._bound(None, f.value - isinstance(f, LessThan))
            yield f

    def _bound(self, lo: int | None, hi: int | None) -> None:
        if lo is not None:
            self.lo = lo if self.lo is None else max(lo, self.lo)
        if hi is not None:
            self.hi = hi if self.hi is None else min(hi, self.hi)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for first, path, shape, dtype, begin in files(self.path):
            each = max(self.size // max(shape[1] * shape[2] * dtype.itemsize, 1), 1)
            a = max((self.lo if self.lo is not None else first) - first, 0)
            b = min((self.hi + 1 if self.hi is not None else first + shape[0]) - first, shape[0])
            out += [Steps(path, first, i, min(i + each, b), begin, shape, dtype.str) for i in range(a, b, each)]
        return out or [Steps("", 0, 0, 0, 0, (0, 0, 0), "<f8")]

    def read(self, partition: Steps) -> Iterator[pa.RecordBatch]:
        p, dtype = partition, np.dtype(partition.dtype)
        cells = p.shape[1] * p.shape[2]
        if p.hi <= p.lo or not cells:
            return
        cell = np.arange(cells)
        lat, lon = (cell // p.shape[2]).astype(np.int32), (cell % p.shape[2]).astype(np.int32)
        # a partition has the path without its scheme, as the file system gave it
        store = _open(self.path)[0]
        with store.open_input_file(p.path) as f:
            for t in range(p.lo, p.hi):
                f.seek(p.begin + t * cells * dtype.itemsize)
                value = np.frombuffer(f.read(cells * dtype.itemsize), dtype).astype(np.float64)
                columns = [pa.array(np.full(cells, p.first + t, np.int32)), pa.array(lat), pa.array(lon), pa.array(cell), pa.array(value, from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns, ["time_idx", "lat_idx", "lon_idx", "pixel_id", "value"])


class NpySource(DataSource):
    """``spark.read.format("npy").load(path)``; option ``range``: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("range", RANGE)))


def read_npy(spark: SparkSession, path: str, n_lat: int | None = None, n_lon: int | None = None, n_time: int | None = None) -> DataFrame:
    """The cells of an array or a folder of arrays, NaN as NULL; raises where the shape is another than
    the one given."""
    found = files(path)
    have = (sum(f[2][0] for f in found), *found[0][2][1:])
    if any(want is not None and want != got for want, got in zip((n_time, n_lat, n_lon), have, strict=True)):
        raise ValueError(f"{path} has the shape {have}, not {(n_time, n_lat, n_lon)}")
    spark.dataSource.register(NpySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("npy").load(path)


def write_npy(df: DataFrame, value: str, path: str, n_lat: int, n_lon: int, steps: int = 12, dtype: str = "float32") -> None:
    """``df`` (``time_idx, lat_idx, lon_idx`` and the value) as a folder of arrays of ``steps`` steps each, one
    task a file; cells that are not there are NaN, of cells that are there twice the larger counts. Latitudes
    ascend with their index. A cell outside the grid raises."""
    spark = df.sparkSession
    outside = df.where(~(F.col("lat_idx").between(0, n_lat - 1) & F.col("lon_idx").between(0, n_lon - 1) & (F.col("time_idx") >= 0)))
    if not outside.isEmpty():
        raise ValueError(f"a cell is outside the grid of {n_lat} x {n_lon}: {outside.first()}")
    last = df.agg(F.max("time_idx")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(path)
        store.create_dir(base, recursive=True)
        block, at = None, -1

        def done() -> Iterator[pa.RecordBatch]:
            if block is not None:
                head = io.BytesIO()
                np.lib.format.write_array_header_1_0(head, {"descr": np.dtype(dtype).str, "fortran_order": False, "shape": block.shape})
                with store.open_output_stream(f"{base}/t{at * steps:09d}.npy", compression=None) as f:
                    f.write(head.getvalue())
                    f.write(block.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64())], ["block"])

        for b in batches:
            blocks, t, i, j = (b.column(c).to_numpy() for c in ("block", "time_idx", "lat_idx", "lon_idx"))
            v = b.column("value").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if blocks[lo] != at:
                    yield from done()
                    at = int(blocks[lo])
                    block = np.full((min(steps, last + 1 - at * steps), n_lat, n_lon), np.nan, dtype)
                block[t[lo:hi] - at * steps, i[lo:hi], j[lo:hi]] = v[lo:hi]
        yield from done()

    cells = df.groupBy("time_idx", "lat_idx", "lon_idx").agg(F.max(F.col(value).cast("double")).alias("value"))
    cells = cells.withColumn("block", F.floor(F.col("time_idx") / steps))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = cells.repartition(n, "block").sortWithinPartitions("block").mapInArrow(run, "block long")
    written.write.format("noop").mode("overwrite").save()
