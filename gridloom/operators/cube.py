"""Operators on wide cubes: masks, annual values, lags, climatology, trends.

All take and return DataFrames with ``pixel_id, time_idx, time`` and value columns. Work
is grouped by pixel throughout, so that a chain of them shuffles once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.slopes import median_slopes
from gridloom.functions.stats import DAYS_PER_YEAR, is_finite
from gridloom.sources.cube import load_json, publish, read_bucketed, save_json, write_bucketed

SUMMED = ("TP", "SSRD")
EXCLUDING = ("bs", "ebf")


@dataclass(frozen=True)
class MaskPart:
    """One part of a mask: a column, and which of its values keep a pixel: those in
    ``codes`` if given, else true ones, or with ``exclude`` those that are not true."""

    column: str
    codes: tuple[int, ...] | None = None
    exclude: bool = False

    @staticmethod
    def named(name: str, codes: tuple[int, ...] | None = None) -> MaskPart:
        """By the usual names: ``bs``, ``ebf`` and ``landcover_x`` exclude."""
        return MaskPart(name, codes, codes is None and (name in EXCLUDING or name.startswith("landcover_")))

    def keeps(self) -> Column:
        c = F.col(self.column)
        if self.codes is not None:
            return F.coalesce(c.isin(list(self.codes)), F.lit(False))
        truth = F.coalesce(c.cast("int") != 0, F.lit(False))
        return ~truth if self.exclude else truth


def with_mask(df: DataFrame, parts: list[MaskPart], name: str = "kept") -> DataFrame:
    """All parts together as one boolean column."""
    out = F.lit(True)
    for p in parts:
        out = out & p.keeps()
    return df.withColumn(name, out)


def mask_stats(pixels: DataFrame, name: str = "kept") -> DataFrame:
    return pixels.agg(F.count_if(F.col(name)).alias("n_kept"), F.count(F.lit(1)).alias("n_total"), F.avg(F.col(name).cast("int")).alias("fraction"))


def apply_mask(df: DataFrame, values: list[str], keep: Column | str) -> DataFrame:
    """Nulls the values where the mask does not keep; rows stay, so the cube is dense."""
    keep = F.col(keep) if isinstance(keep, str) else keep
    return df.withColumns({v: F.when(keep, F.col(v)) for v in values})


def join_mask(cube: DataFrame, mask: DataFrame, values: list[str], keep: str = "kept") -> DataFrame:
    """The same with a mask of its own, a row per pixel."""
    joined = cube.join(mask.select("pixel_id", F.col(keep).alias("__keep")), "pixel_id", "left")
    return apply_mask(joined, values, F.coalesce("__keep", F.lit(False))).drop("__keep")


def misaligned(cube: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels that are in only one of both."""
    a, b = cube.select("pixel_id").distinct(), mask.select("pixel_id").distinct()
    return a.join(b, "pixel_id", "left_anti").unionByName(b.join(a, "pixel_id", "left_anti"))


def annual_rule(variable: str) -> str:
    """``sum`` for totals, else ``mean``; by name, by its base, or by its prefix."""
    base = variable.upper().split("_LAG_")[0].split("_")[0]
    return "sum" if base in SUMMED else "mean"


def annual(df: DataFrame, values: dict[str, str], full_years: bool = True) -> DataFrame:
    """Yearly ``mean`` or ``sum`` per pixel, dated January 1. The sum of a year without
    values is 0. With ``full_years`` years raise unless all have 12 months, or all a single
    one, whose values they keep."""
    if full_years:
        lengths = year_lengths(df)
        most = F.max("n_months").over(Window.partitionBy())  # a row a year
        odd = lengths.withColumn("most", most).where("n_months <> CASE WHEN most = 1 THEN 1 ELSE 12 END")
        if not odd.isEmpty():
            raise ValueError(f"incomplete years: {[r[0] for r in odd.orderBy('year').limit(10).collect()]}")
    alone = (F.count(F.lit(1)) == 1) & F.lit(full_years)
    how = {"mean": F.avg, "sum": lambda v: F.when(alone, F.max(v)).otherwise(F.coalesce(F.sum(v), F.lit(0.0)))}
    out = df.groupBy("pixel_id", F.year("time").alias("year")).agg(*[how[rule](v).alias(v) for v, rule in values.items()])
    return out.withColumn("time", F.make_date("year", F.lit(1), F.lit(1)))


def annual_series(df: DataFrame, value: str, rule: str, origin: int, lag: int = 0) -> DataFrame:
    """Yearly values numbered by the calendar, from ``origin`` on, so that variables of other
    spans meet in the same years; a lag is of years and comes after the aggregation, so the first
    ``lag`` years of the rows given have none."""
    out = annual(df, {value: rule}).withColumn("time_idx", F.col("year") - F.lit(origin))
    return shift(out, [value], lag) if lag else out


def year_lengths(df: DataFrame) -> DataFrame:
    return df.select(F.year("time").alias("year"), F.month("time").alias("month")).distinct().groupBy("year").agg(F.count(F.lit(1)).alias("n_months"))


def full_years(df: DataFrame) -> DataFrame:
    """Only the rows of years with all 12 months."""
    whole = year_lengths(df).where("n_months = 12").select(F.col("year").alias("__year"))
    return df.join(F.broadcast(whole), F.year("time") == F.col("__year")).drop("__year")


def shift(df: DataFrame, values: list[str], steps: int, suffix: str = "") -> DataFrame:
    """Each value that many steps earlier, by the time index and not by rows, so that a
    gap gives NULL and not another month's value."""
    if steps < 0:
        raise ValueError("steps must not be negative")
    keys = ["variable", "pixel_id"] if "variable" in df.columns else ["pixel_id"]
    w = Window.partitionBy(*keys).orderBy("time_idx").rangeBetween(-steps, -steps)
    return df.withColumns({f"{v}{suffix}": F.max(v).over(w) for v in values})


def lags(df: DataFrame, values: list[str], steps: list[int]) -> DataFrame:
    """``X_LAG_k`` for every value and k, in one pass over each pixel."""
    for k in steps:
        df = shift(df, values, k, f"_LAG_{k}")
    return df


def write_lags(long: DataFrame, path: str, steps: list[int]) -> DataFrame:
    """Writes ``X_LAG_k`` of every variable of a long cube and every k, a partition each, and
    reads them back; raises unless each has as many rows as its base, and then leaves what was at
    ``path`` as it is."""
    lagged = lags(long, ["value"], steps)
    names = [f"value_LAG_{k}" for k in steps]
    keys = [c for c in long.columns if c not in ("variable", "value")]
    tall = lagged.unpivot(["variable", *keys], names, "lag", "value")
    tall = tall.withColumn("variable", F.concat("variable", F.expr("substring(lag, 6)"))).drop("lag")
    spark = long.sparkSession
    found = long.groupBy("variable").count()
    want = found.withColumn("k", F.explode(F.array(*[F.lit(k) for k in steps]))).select(F.concat("variable", F.lit("_LAG_"), "k").alias("variable"), "count")

    def check(at: str) -> None:
        got = spark.read.parquet(at).groupBy("variable").count()
        if odd := [r["variable"] for r in want.exceptAll(got).collect()]:
            raise ValueError(f"{path} lacks rows of {sorted(odd)}")

    publish(spark, path, lambda at: tall.write.partitionBy("variable").parquet(at), check)
    return spark.read.parquet(path)


def _season(resolution: str) -> list[Column]:
    if resolution not in ("monthly", "annual"):
        raise ValueError(resolution)
    return [F.month("time")] if resolution == "monthly" else []


def climatology(df: DataFrame, values: list[str], resolution: str = "monthly") -> DataFrame:
    """Mean per pixel and calendar month, or per pixel."""
    season = [m.alias("month") for m in _season(resolution)]
    return df.groupBy("pixel_id", *season).agg(*[F.avg(v).alias(v) for v in values])


def anomaly(df: DataFrame, values: list[str], resolution: str = "monthly") -> DataFrame:
    """Value minus the pixel's climatology, without a join."""
    w = Window.partitionBy("pixel_id", *_season(resolution))
    return df.withColumns({v: F.col(v) - F.avg(v).over(w) for v in values})


def centred_years(df: DataFrame) -> DataFrame:
    """``time, time_years``: each step in years of 365.2425 days from the axis' mean."""
    steps = df.select("time").distinct()
    first = F.broadcast(steps.agg(F.min("time").alias("__t0"), F.avg(F.unix_date("time")).alias("__mean"), F.avg(F.lit(1.0)).alias("__one")))
    t = (F.datediff("time", "__t0") - (F.col("__mean") - F.unix_date("__t0"))) / DAYS_PER_YEAR
    return steps.crossJoin(first).select("time", t.alias("time_years"))


def theil_sen(df: DataFrame, value: str) -> DataFrame:
    """``pixel_id, slope``: the median slope over all pairs of steps, per year; 0 for
    fewer than two values. A pixel's series is one array, and its pairs never are rows; of long
    series they are only counted (``functions.slopes``)."""
    day = F.unix_date("time") / F.lit(DAYS_PER_YEAR)
    point = F.when(is_finite(value), F.struct(day.alias("x"), F.col(value).cast("double").alias("y")))
    series = df.groupBy("pixel_id").agg(F.sort_array(F.collect_list(point)).alias("s"))
    return median_slopes(series)


def detrend(df: DataFrame, value: str, slopes: DataFrame, years: DataFrame) -> DataFrame:
    """Value minus slope times centred time; the mean stays."""
    joined = df.join(F.broadcast(years), "time").join(slopes, "pixel_id")
    return joined.withColumn(value, F.col(value) - F.col("slope") * F.col("time_years")).drop("slope", "time_years")


def retrend(df: DataFrame, value: str, slopes: DataFrame, years: DataFrame) -> DataFrame:
    joined = df.join(F.broadcast(years), "time").join(slopes, "pixel_id")
    return joined.withColumn(value, F.col(value) + F.col("slope") * F.col("time_years")).drop("slope", "time_years")


def add_climatology(df: DataFrame, value: str, clim: DataFrame) -> DataFrame:
    on = ["pixel_id", "month"] if "month" in clim.columns else ["pixel_id"]
    c = clim.select(*on, F.col(value).alias("__c"))
    out = df.withColumn("month", F.month("time")).join(c, on, "left")
    return out.withColumn(value, F.col(value) + F.col("__c")).drop("__c", "month")


@dataclass(frozen=True)
class Preprocessed:
    """A processed variable, and the small tables that its inverse needs."""

    data: DataFrame
    climatology: DataFrame | None
    slopes: DataFrame | None
    years: DataFrame | None

    @property
    def steps(self) -> list[str]:
        """What was done, in order; the inverse undoes it from the end."""
        return ["anomaly"] * (self.climatology is not None) + ["detrend"] * (self.slopes is not None)

    def save(self, folder: str, buckets: list[str] | None = None) -> None:
        """Writes each table, the data in ``buckets`` of these keys if given, and last which there
        are, their columns, and how many rows, pixels and steps each has."""
        spark = self.data.sparkSession
        kept = {n: df for n in ("data", "climatology", "slopes", "years") if (df := getattr(self, n)) is not None}
        products = {}
        for name, df in kept.items():
            if bucketed := bool(buckets) and name == "data":
                write_bucketed(df, f"{folder}/{name}", buckets)
            else:
                df.write.mode("overwrite").parquet(f"{folder}/{name}")
            back = spark.read.parquet(f"{folder}/{name}/rows" if bucketed else f"{folder}/{name}")
            axes = [c for c in ("pixel_id", "time_idx", "time", "month") if c in df.columns]
            counts = back.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in axes]).first().asDict()
            products[name] = {"columns": dict(df.dtypes), "shape": counts, "bucketed": bucketed}
        save_json(spark, {"steps": self.steps, "products": products}, f"{folder}/products")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Preprocessed:
        products = load_json(spark, f"{folder}/products")["products"]
        load = lambda n: read_bucketed(spark, f"{folder}/{n}") if products[n]["bucketed"] else spark.read.parquet(f"{folder}/{n}")
        read = lambda n: load(n) if n in products else None
        return Preprocessed(*(read(n) for n in ("data", "climatology", "slopes", "years")))


def preprocess(df: DataFrame, value: str, resolution: str = "monthly", value_type: str = "real", detrended: bool = False) -> Preprocessed:
    """Anomaly if asked for, then Theil-Sen detrending if asked for."""
    clim = slopes = years = None
    if value_type == "anomaly":
        clim = climatology(df, [value], resolution)
        df = anomaly(df, [value], resolution)
    elif value_type != "real":
        raise ValueError(value_type)
    if detrended:
        slopes, years = theil_sen(df, value), centred_years(df)
        df = detrend(df, value, slopes, years)
    return Preprocessed(df, clim, slopes, years)


def reconstruct(p: Preprocessed, value: str) -> DataFrame:
    """The exact inverse: trend back, then climatology back."""
    df = p.data
    if p.slopes is not None and p.years is not None:
        df = retrend(df, value, p.slopes, p.years)
    if p.climatology is not None:
        df = add_climatology(df, value, p.climatology)
    return df


def coarsen(df: DataFrame, value: str, block: int, threshold: float) -> DataFrame:
    """Mean over blocks of cells, and whether it reaches the threshold."""
    return df.groupBy(F.floor(F.col("lat_idx") / block).cast("int").alias("lat_idx"), F.floor(F.col("lon_idx") / block).cast("int").alias("lon_idx")).agg(F.avg(value).alias("mean")).withColumn("flag", F.col("mean") >= threshold)


def always_valid(df: DataFrame, value: str) -> DataFrame:
    """Per pixel whether every step has a value."""
    return df.groupBy("pixel_id").agg(F.bool_and(F.col(value).isNotNull()).alias("valid"))


def nearest_cells(points: DataFrame, step: float, n_lat: int, n_lon: int) -> DataFrame:
    """The grid cell of each ``latitude, longitude``; NULL outside."""
    lat, lon = F.floor((F.col("latitude") + 90) / step).cast("int"), F.floor((F.col("longitude") + 180) / step).cast("int")
    inside = lat.between(0, n_lat - 1) & lon.between(0, n_lon - 1)
    return points.withColumns({"lat_idx": F.when(inside, lat), "lon_idx": F.when(inside, lon)}).withColumn("pixel_id", F.col("lat_idx") * n_lon + F.col("lon_idx"))


#: Grids of up to so many cells are sent to all tasks, some 50 MB.
BROADCAST_CELLS = 1_000_000


def resample_nearest(points: DataFrame, value: str, grid: DataFrame, step: float, fill: float | None = None) -> DataFrame:
    """``grid`` (``lat_idx, lon_idx, latitude, longitude`` of cell centres ``step`` apart) with the ``value`` of the
    nearest of ``points`` (``latitude, longitude`` and the value): of those in the cell, on its edge or in the eight
    cells around it, by distance in degrees, then from the south, the west, and the least value;
    ``fill`` where there are none. A point goes to the cells around it, so the grid is
    joined once and no pair of far ones is made. The least distance of each cell is found first, as
    a number, which is hashed and not sorted; the points at that distance, few or at few
    places, are compared in full."""
    place, distance = ["lat_idx", "lon_idx"], ["lat_idx", "lon_idx", "d"]
    lat0, lon0 = (F.min(F.col(c) - F.lit(step) * F.col(i)) for c, i in (("latitude", "lat_idx"), ("longitude", "lon_idx")))
    *origin, n_cells = grid.agg(lat0, lon0, F.count(F.lit(1))).first()
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    known = points.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col(value).isNotNull())
    start = [F.lit(o).cast("double") for o in origin]
    cell = [F.floor((F.col(c) - o) / step + 0.5).cast("int") + F.col(f"__near.{k}") for c, o, k in zip(("latitude", "longitude"), start, "ij", strict=True)]
    centre = [o + F.lit(step) * c for o, c in zip(start, cell, strict=True)]
    far = F.pow(F.col("latitude") - centre[0], F.lit(2)) + F.pow(F.col("longitude") - centre[1], F.lit(2))
    dealt = known.withColumn("__near", around).select(cell[0].alias("lat_idx"), cell[1].alias("lon_idx"), F.round(far, 9).alias("d"), "latitude", "longitude", F.col(value).alias("v"))
    least = dealt.groupBy(*place).agg(F.min("d").alias("d")).join(grid.select(*place), place, "left_semi")
    nearest = dealt.join(F.broadcast(least) if n_cells <= BROADCAST_CELLS else least, distance)
    at_once = nearest.groupBy(*distance, "latitude", "longitude").agg(F.min("v").alias("v"))  # points of one place
    found = at_once.groupBy(*place).agg(F.min(F.struct("latitude", "longitude", "v")).alias("__s"))
    out = grid.join(found, place, "left")
    return out.withColumn(value, F.coalesce(F.col("__s.v"), F.lit(fill)) if fill is not None else F.col("__s.v")).drop("__s")


def stride(df: DataFrame, n: int) -> DataFrame:
    """Every n-th cell of both axes, for a preview."""
    return df.where((F.col("lat_idx") % n == 0) & (F.col("lon_idx") % n == 0))
