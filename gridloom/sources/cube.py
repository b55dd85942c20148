"""Cubes: tables of cells keyed by pixel and time, and how they are read and written.

A long cube has ``variable, time_idx, time, pixel_id, lat_idx, lon_idx, value``; a wide
one has a column per variable. Every pixel has a row for every time step (the spine), so
that a shift by rows is a shift in time; what is missing is NULL, not absent.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.functions.stats import null_if_nan

KEYS = ["pixel_id", "time_idx"]
LONG_COLUMNS = ["variable", "time_idx", "time", "pixel_id", "value"]
#: Other names of the axes.
AXES = {"lat": "latitude", "y": "latitude", "lon": "longitude", "x": "longitude"}
#: What the codes of the usual masks mean where a folder does not say.
LABELS = {
    "climate": {1: "Tropical", 2: "Dry", 3: "Temperate", 4: "Continental", 5: "Polar"},
    "landcover": {10: "Tree cover", 20: "Shrubland", 30: "Grassland", 40: "Cropland", 70: "Snow and ice", 90: "Herbaceous wetland", 100: "Moss and lichen"},
}


@dataclass(frozen=True)
class Roi:
    """A box of latitudes and longitudes, both bounds included."""

    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float

    def __post_init__(self) -> None:
        if not -90 <= self.lat_min < self.lat_max <= 90:
            raise ValueError("latitudes must satisfy -90 <= min < max <= 90")
        if not -180 <= self.lon_min < self.lon_max <= 180:
            raise ValueError("longitudes must satisfy -180 <= min < max <= 180")

    @staticmethod
    def of(roi: Roi | dict) -> Roi:
        return roi if isinstance(roi, Roi) else Roi(**roi)


@dataclass(frozen=True)
class Grid:
    """A regular grid: the first centre, step and count of both axes, and the months or
    years of the time axis."""

    lat0: float
    lon0: float
    step: float
    n_lat: int
    n_lon: int
    start: str
    n_time: int
    months: int = 1

    def times(self, spark: SparkSession) -> DataFrame:
        step = F.expr(f"add_months(DATE'{self.start}', cast(id * {self.months} as int))")
        return spark.range(self.n_time).select(F.col("id").cast("int").alias("time_idx"), step.alias("time"))

    def pixels(self, spark: SparkSession) -> DataFrame:
        row, column = F.floor(F.col("id") / self.n_lon).cast("int"), (F.col("id") % self.n_lon).cast("int")
        return spark.range(self.n_lat * self.n_lon).select(
            F.col("id").cast("int").alias("pixel_id"),
            row.alias("lat_idx"),
            column.alias("lon_idx"),
            (self.lat0 + row * self.step).alias("latitude"),
            (self.lon0 + column * self.step).alias("longitude"),
        )


def parse_variable(name: str) -> tuple[str, int]:
    """``X_LAG_n`` to (X, n); any other name to (name, 0)."""
    name = name.strip().upper()
    base, _, lag = name.rpartition("_LAG_")
    if not (lag.isascii() and lag.isdigit() and base.isascii() and base.replace("_", "A").isalnum()):
        return name, 0
    if int(lag) < 1:
        raise ValueError(f"a lag is at least 1: {name}")
    return base, int(lag)


def parse_variables(df: DataFrame, name: str = "name") -> DataFrame:
    """The same over a column: adds ``base`` and ``lag``."""
    n = F.upper(F.trim(F.col(name)))
    lag = F.substring_index(n, "_LAG_", -1)
    base = F.substring(n, F.lit(1), F.length(n) - F.length(lag) - len("_LAG_"))
    lagged = F.contains(n, F.lit("_LAG_")) & lag.rlike("^[0-9]+$") & base.rlike("^[A-Z0-9_]+$")
    return df.withColumns({"base": F.when(lagged, base).otherwise(n), "lag": F.when(lagged, lag.cast("int")).otherwise(0)})


def expand_names(requested: list[str], known: list[str]) -> list[str]:
    """A name that is not there stands for all that begin with it and ``_``."""
    out: list[str] = []
    for name in requested:
        found = [name] if name in known else sorted(k for k in known if k.startswith(f"{name}_"))
        if not found:
            raise KeyError(name)
        out += [f for f in found if f not in out]
    return out


def select_time(df: DataFrame, start_year: int | None = None, end_year: int | None = None) -> DataFrame:
    """Both years included; both bounds or neither."""
    if start_year is None and end_year is None:
        return df
    if start_year is None or end_year is None or start_year > end_year:
        raise ValueError("give both years, in order")
    return df.where(F.col("time").between(F.lit(f"{start_year}-01-01").cast("date"), F.lit(f"{end_year}-12-31").cast("date")))


def select_roi(df: DataFrame, roi: Roi | dict | None) -> DataFrame:
    """The cells in the box; a box without any raises."""
    if roi is None:
        return df
    r = Roi.of(roi)
    out = df.where(F.col("latitude").between(r.lat_min, r.lat_max) & F.col("longitude").between(r.lon_min, r.lon_max))
    if out.isEmpty():
        raise ValueError(f"no cell is in {r}")
    return out


def standard_axes(df: DataFrame) -> DataFrame:
    """Columns that name the axes otherwise (``lat``, ``y``, ``lon``, ``x``) get their usual names."""
    names = {c: AXES[c.lower()] for c in df.columns if c.lower() in AXES and AXES[c.lower()] not in df.columns}
    if len(set(names.values())) < len(names):
        raise ValueError(f"an axis is there twice: {sorted(names)}")
    return df.withColumnsRenamed(names)


def only_value(df: DataFrame, keys: list[str]) -> str:
    """The one column that is no key."""
    values = [c for c in df.columns if c not in keys]
    if len(values) != 1:
        raise ValueError(f"one value column is expected, not {values}")
    return values[0]


def axis_index(df: DataFrame, axis: str, name: str) -> DataFrame:
    """Adds the place of each coordinate on its axis, in ascending order. The axis is as long
    as the grid is wide, so its distinct coordinates are put in order in one task."""
    from pyspark.sql import Window

    order = df.select(axis).distinct().withColumn(name, (F.row_number().over(Window.orderBy(axis)) - 1).cast("int"))
    return df.join(order, axis)


def flip_rows(df: DataFrame, n_lat: int) -> DataFrame:
    """Rows counted from the other end of the latitudes."""
    return df.withColumn("lat_idx", F.lit(n_lat - 1) - F.col("lat_idx"))


def with_coordinates(df: DataFrame, pixels: DataFrame, times: DataFrame) -> DataFrame:
    """Adds ``latitude, longitude, time`` by ``pixel_id`` and ``time_idx``; a row outside the grid raises."""
    out = df.join(pixels.select("pixel_id", "latitude", "longitude"), "pixel_id", "left").join(times.select("time_idx", "time"), "time_idx", "left")
    outside = out.where("latitude IS NULL OR time IS NULL")
    if not outside.isEmpty():
        raise IndexError(f"outside the grid: {outside.select(*KEYS).first()}")
    return out


def stack_classes(df: DataFrame, variable: str) -> DataFrame:
    """A variable of several classes as a variable for each, ``X_CLASS_c``."""
    return df.withColumn("variable", F.concat(F.lit(f"{variable.upper()}_CLASS_"), F.col("class").cast("string"))).drop("class")


def labels_of(spark: SparkSession, path: str | None, mask: str) -> DataFrame:
    """``code, label`` of a mask, from a table kept at ``path``; where there is none or it may
    not be read, the usual ones."""
    try:
        if path is not None:
            return spark.read.parquet(path).where(F.col("mask") == mask).select("code", "label")
    except Exception as e:  # Spark names it in several classes
        if not any(x in str(e) for x in ("PATH_NOT_FOUND", "does not exist", "Permission denied")):
            raise
    return spark.createDataFrame(sorted(LABELS[mask].items()), "code int, label string")


def available_masks(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The masks that the folder has; the others are left out."""
    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def combined_mask(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """``pixel_id, kept`` of the named masks of a folder together, a table for each with a column of
    its name; a name that the folder does not have raises."""
    from gridloom.operators.cube import MaskPart, with_mask

    found = available_masks(spark, folder, names)
    if unknown := [n for n in names if n not in found]:
        raise ValueError(f"{folder} has no masks {unknown}")
    if not names:
        raise ValueError("no mask is named")
    joined = reduce(lambda a, b: a.join(b, "pixel_id", "full"), [df.select("pixel_id", n) for n, df in found.items()])
    return with_mask(joined, [MaskPart.named(n) for n in names]).select("pixel_id", "kept")


def read_files(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """The Parquet files of a folder whose names fit; none raises."""
    try:
        return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)
    except AnalysisException as e:
        if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            raise
        raise FileNotFoundError(f"{folder}/{pattern}") from e


def read_cube(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Several variables of a long cube; a name that is not there stands for all that begin
    with it. The names come from the partitions, and only theirs are read."""
    df = spark.read.parquet(path)
    known = [r[0] for r in df.select("variable").distinct().collect()]
    return df.where(F.col("variable").isin(expand_names(names, known)))


def read_variable(spark: SparkSession, path: str, variable: str, roi: Roi | dict | None = None, start_year: int | None = None, end_year: int | None = None) -> DataFrame:
    """A variable of a long cube kept as Parquet partitioned by ``variable``: only its
    partition is read, and years and box reach the scan as filters; for a lagged one the
    steps before the first year that the lag needs are read too."""
    base, lag = parse_variable(variable)
    df = spark.read.parquet(path)
    if missing := [c for c in LONG_COLUMNS if c not in df.columns]:
        raise ValueError(f"not a long cube, it lacks {missing}")
    df = df.where(F.upper("variable") == base)
    if df.isEmpty():
        raise ValueError(f"there is no variable {base} in {path}")
    df = select_roi(df, roi)
    if lag:
        from gridloom.operators.cube import shift

        if start_year is not None and end_year is not None:
            first = select_time(df, start_year, end_year).agg(F.min("time_idx")).first()[0]
            df = df.where((F.col("time") <= F.make_date(F.lit(end_year), F.lit(12), F.lit(31))) & (F.col("time_idx") >= (0 if first is None else first) - lag))
        df = shift(df, ["value"], lag)
    return select_time(df, start_year, end_year).withColumn("variable", F.lit(variable)).withColumn("value", null_if_nan("value"))


def write_cube(cube: DataFrame, path: str) -> None:
    cube.write.mode("overwrite").partitionBy("variable").parquet(path)


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int | None = None, in_order: bool = True) -> None:
    """Writes ``df`` in buckets of its keys, sorted in each if ``in_order``, so that tables of as many buckets are
    joined by them where they are. The catalogue has the table while it is written; one that
    takes no table gets none, and the rows are in no buckets."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"gridloom_{uuid.uuid4().hex}"
    dealt = df.repartition(n, *keys)
    try:
        writer = dealt.write.mode("overwrite").bucketBy(n, *keys)
        (writer.sortBy(*keys) if in_order else writer).option("path", f"{path}/rows").saveAsTable(name)
    except AnalysisException:
        n = 0
        dealt.write.mode("overwrite").parquet(f"{path}/rows")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    save_json(spark, {"keys": keys, "buckets": n, "in_order": in_order, "schema": json.loads(df.schema.json())}, f"{path}/buckets")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_bucketed`` wrote. Spark knows buckets by the catalogue only, so the table is
    there while it is looked up, under a name of its own; where the catalogue takes no table the
    rows are read without."""
    info = load_json(spark, f"{path}/buckets")
    schema, name = StructType.fromJson(info["schema"]), f"gridloom_{uuid.uuid4().hex}"
    if not info["buckets"]:
        return spark.read.schema(schema).parquet(f"{path}/rows")
    columns, keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), ", ".join(info["keys"])
    order = f"SORTED BY ({keys}) " if info["in_order"] else ""
    try:
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) {order}INTO {info['buckets']} BUCKETS LOCATION '{path}/rows'")
        return spark.table(name)
    except AnalysisException:
        return spark.read.schema(schema).parquet(f"{path}/rows")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def publish(spark: SparkSession, path: str, write: Callable[[str], object], check: Callable[[str], object]) -> None:
    """Has ``write`` put a folder aside and ``check`` look at it, then gives it the name ``path``. What
    was there stays until then, and for good where one of both raises."""
    new, old = f"{path.rstrip('/')}__new", f"{path.rstrip('/')}__old"
    at = {p: spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old)}
    fs = at[path].getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at[new], True)
    try:
        write(new)
        check(new)
    except BaseException:
        fs.delete(at[new], True)
        raise
    fs.delete(at[old], True)
    if fs.exists(at[path]) and not fs.rename(at[path], at[old]):
        raise OSError(f"{path} can not be put aside")
    if not fs.rename(at[new], at[path]):
        fs.rename(at[old], at[path])
        raise OSError(f"{new} can not be renamed")
    fs.delete(at[old], True)


def spine(pixels: DataFrame, times: DataFrame) -> DataFrame:
    """All pixels at all steps between the first and the last of ``times``."""
    span = times.agg(F.min("time_idx").alias("__lo"), F.max("time_idx").alias("__hi"))
    return pixels.crossJoin(F.broadcast(span)).withColumn("time_idx", F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")


def densify(cells: DataFrame, pixels: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """``cells`` with a row for every pixel and step; what was not there is NULL. ``times``: where the
    first and last step are read, if the cells themselves are costly to make."""
    return spine(pixels, (cells if times is None else times).select("time_idx")).join(cells, KEYS, "left")


def to_long(wide: DataFrame, variables: list[str], keys: list[str]) -> DataFrame:
    return wide.unpivot(keys, variables, "variable", "value")


def to_wide(long: DataFrame, variables: list[str], keys: list[str]) -> DataFrame:
    return long.groupBy(*keys).pivot("variable", variables).agg(F.first("value"))


def check_grid(df: DataFrame, south: float = -90, north: float = 90, west: float = -180, east: float = 180) -> None:
    """Raises where coordinates are out of range or cells repeat. The range is the globe's, unless the
    grid's own is given, which may be in other units than degrees."""
    odd = F.count_if(~F.col("latitude").between(south, north) | ~F.col("longitude").between(west, east))
    if df.agg(odd).first()[0]:
        raise ValueError("coordinates out of range")
    if not df.groupBy(*KEYS).count().where("count > 1").isEmpty():
        raise ValueError("a cell is there twice")


def check_shape(df: DataFrame, n_pixels: int, n_time: int) -> None:
    """Raises unless there is one cell for each pixel and step."""
    got = df.agg(F.count_distinct("pixel_id"), F.count_distinct("time_idx"), F.count(F.lit(1))).first()
    if tuple(got) != (n_pixels, n_time, n_pixels * n_time):
        raise ValueError(f"{n_pixels} pixels of {n_time} steps are expected, not {got[0]}, {got[1]} and {got[2]} cells")


def time_resolution(times: DataFrame) -> DataFrame:
    """One row ``resolution``: monthly or annual where all steps are 1 or 12 months."""
    from pyspark.sql import Window

    month = F.year("time") * 12 + F.month("time")
    gap = month - F.lag(month).over(Window.orderBy("time"))
    steps = times.select("time").distinct().withColumn("gap", gap)
    lo, hi = F.min("gap"), F.max("gap")
    return steps.agg(F.when((lo == 1) & (hi == 1), "monthly").when((lo == 12) & (hi == 12), "annual").when(lo.isNull(), "unknown").otherwise("irregular").alias("resolution"))


def grid_metadata(df: DataFrame) -> DataFrame:
    """Bounds, counts and resolution of both axes and of time, one row."""
    step = lambda c: (F.max(c) - F.min(c)) / F.nullif(F.count_distinct(c) - 1, F.lit(0))
    return df.agg(
        F.min("lat_idx").alias("lat_min"), F.max("lat_idx").alias("lat_max"), F.count_distinct("lat_idx").alias("n_lat"),
        F.min("lon_idx").alias("lon_min"), F.max("lon_idx").alias("lon_max"), F.count_distinct("lon_idx").alias("n_lon"),
        F.count_distinct("time_idx").alias("n_time"), F.min("time").alias("time_min"), F.max("time").alias("time_max"),
        F.round(step("lat_idx"), 6).alias("lat_step"), F.round(step("lon_idx"), 6).alias("lon_step"),
    )


def save_json(spark: SparkSession, value: object, path: str) -> None:
    """A small JSON document in a folder that Spark writes, so that any store works."""
    if hasattr(value, "__dataclass_fields__"):
        value = asdict(value)
    spark.range(1).select(F.lit(json.dumps(value, default=str)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def variables_of(metadata: dict) -> dict:
    """The entries of the variables: below ``variables``, or, as older files have it, at the top,
    where an entry is what has a ``path``."""
    found = metadata.get("variables", metadata)
    return {k: v for k, v in found.items() if isinstance(v, dict) and (found is not metadata or "path" in v)}


def load_json(spark: SparkSession, path: str) -> object:
    return json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
