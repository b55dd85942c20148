"""Regression metrics of a prediction table, globally and in groups.

Rows are ``y_true, y_pred`` with their pixel, time and categories. Residuals are
prediction minus truth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.quantiles import quantile, quantiles, quantiles_of
from gridloom.functions.stats import all_finite, bias, fit_intercept, fit_slope, mae, pair, r2, rmse, safe_corr
from gridloom.sources.scratch import settled

Y, P = "y_true", "y_pred"


def with_errors(df: DataFrame) -> DataFrame:
    e = F.col(P) - F.col(Y)
    return df.withColumns({"residual": e, "abs_error": F.abs(e), "sq_error": e * e})


def _n() -> Column:
    return F.count(pair(Y, P)[0]).alias("n")


def _core() -> list[Column]:
    return [_n(), rmse(Y, P).alias("rmse"), mae(Y, P).alias("mae")]


def metric_columns() -> list[Column]:
    """Count, RMSE, MAE and R2, to aggregate with."""
    return [*_core(), r2(Y, P, perfect=True).alias("r2")]


def global_metrics(df: DataFrame) -> DataFrame:
    return df.agg(*_core(), r2(Y, P, perfect=True).alias("r2"))


def fit_metrics(df: DataFrame) -> DataFrame:
    """With bias, the line of prediction on truth, and Pearson's r."""
    return df.agg(*_core(), r2(Y, P, perfect=True).alias("r2"), bias(Y, P).alias("bias"), fit_slope(Y, P).alias("slope"), fit_intercept(Y, P).alias("intercept"), safe_corr(Y, P).alias("pearson_r"))


def pixel_metrics(df: DataFrame) -> DataFrame:
    return df.groupBy("pixel_id").agg(*_core(), r2(Y, P, min_var=1e-8).alias("r2"), F.var_pop(pair(Y, P)[0]).alias("y_variance"), F.min("lat_idx").alias("lat_idx"), F.min("lon_idx").alias("lon_idx"))


def pixel_metrics_spatial(df: DataFrame, min_valid: int = 12) -> DataFrame:
    return df.groupBy("pixel_id").agg(*_core(), r2(Y, P).alias("r2"), bias(Y, P).alias("bias"), safe_corr(Y, P, min_valid).alias("corr"))


def metrics_summary(pixels: DataFrame) -> DataFrame:
    """How the pixels' metrics are distributed, one row."""
    q = {c: found.get(None, [None] * 3) for c, found in quantiles_of(pixels, ["r2", "rmse", "mae"], [0.05, 0.5, 0.95]).items()}
    at = lambda c, i: F.lit(q[c][i]).cast("double")
    return pixels.agg(
        F.count(F.lit(1)).alias("n_pixels"), F.count("r2").alias("n_valid_r2"), F.count_if(F.col("r2").isNull()).alias("n_null_r2"),
        F.avg("r2").alias("r2_mean"), F.avg("rmse").alias("rmse_mean"), F.avg("mae").alias("mae_mean"), F.avg("y_variance").alias("variance_mean"),
    ).withColumns({"r2_median": at("r2", 1), "r2_p05": at("r2", 0), "r2_p95": at("r2", 2), "rmse_median": at("rmse", 1), "mae_median": at("mae", 1)})


def best_and_worst(pixels: DataFrame, metric: str = "r2", k: int = 20, ascending: bool | None = None) -> DataFrame:
    """The k best and k worst pixels; small is good for all metrics but r2 and corr."""
    up = metric not in ("r2", "corr") if ascending is None else ascending
    known = pixels.where(all_finite(metric))

    def take(name: str, rising: bool) -> DataFrame:
        order = F.asc(metric) if rising else F.desc(metric)
        return known.orderBy(order, "pixel_id").limit(k).withColumn("kind", F.lit(name))

    return take("best", up).unionByName(take("worst", not up))


def pixel_series(df: DataFrame, pixels: list[int] | DataFrame) -> DataFrame:
    """The predictions of some pixels, to be read by pixel and time."""
    if isinstance(pixels, DataFrame):
        return df.join(pixels.select("pixel_id").distinct(), "pixel_id", "left_semi")
    return df.where(F.col("pixel_id").isin(list(pixels)))


def metrics_by_time(df: DataFrame) -> DataFrame:
    return df.groupBy("time").agg(*_core(), r2(Y, P, perfect=True).alias("r2")).where("n >= 2")


def observation_metrics_by_time(df: DataFrame) -> DataFrame:
    return df.groupBy("time").agg(*_core(), bias(Y, P).alias("bias"))


def pixel_observations(df: DataFrame, keys: tuple[str, ...] = ("pixel_id", "lat_idx", "lon_idx")) -> DataFrame:
    return df.groupBy(*keys).agg(_n(), mae(Y, P).alias("mean_abs_error"), rmse(Y, P).alias("rmse"), bias(Y, P).alias("mean_residual"))


def category_metrics(df: DataFrame, keys: tuple[str, ...] = ("code", "label")) -> DataFrame:
    pixels = F.count_distinct("pixel_id")
    return df.groupBy(*keys).agg(*_core(), r2(Y, P).alias("r2"), bias(Y, P).alias("bias"), pixels.alias("n_pixels"), F.count_distinct("time").alias("n_times"), (F.count(F.lit(1)) / pixels).alias("mean_per_pixel"))


def category_spatial_metrics(df: DataFrame, keys: tuple[str, ...] = ("code", "label"), ignore: tuple[int, ...] = (0,)) -> DataFrame:
    """Per category the metrics of its rows, and the means of its pixels' correlation and bias."""
    known = df.where(~F.col(keys[0]).isin(list(ignore)))
    rows = known.groupBy(*keys).agg(*_core(), r2(Y, P).alias("r2"))
    per = known.groupBy(*keys, "pixel_id").agg(bias(Y, P).alias("bias"), safe_corr(Y, P, 12).alias("corr"))
    means = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pixels"), F.avg("corr").alias("corr_mean"), F.avg("bias").alias("bias_mean"))
    return rows.join(means, list(keys))


def target_year(df: DataFrame, year: int | None) -> DataFrame:
    """The rows of one year; none raises."""
    if year is None:
        return df
    out = df.where(F.year(F.try_to_timestamp(F.col("time").cast("string"))) == year)
    if out.isEmpty():
        raise ValueError(f"no row is of {year}")
    return out


def value_stats(df: DataFrame, value: str) -> DataFrame:
    """What a histogram is marked with: count, mean, deviation and three quantiles of the
    finite values; NULL where there are none."""
    return stats_of(df, [value])[value]


def stats_of(df: DataFrame, values: list[str]) -> dict[str, DataFrame]:
    """The same of several columns, which are scanned together."""
    found, out = quantiles_of(df, values, [0.05, 0.5, 0.95]), {}
    for value in values:
        p05, p50, p95 = found[value].get(None, [None] * 3)
        known = df.where(all_finite(value)).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
        out[value] = known.withColumns({n: F.lit(v).cast("double") for n, v in (("median", p50), ("p05", p05), ("p95", p95))})
    return out


def spatial_bundle(df: DataFrame, pixels: DataFrame, base: str | None = None) -> dict[str, DataFrame]:
    """All tables behind the maps and histograms of a spatial evaluation. The predictions and the
    pixels' metrics are written once to a scratch folder, and every table reads them there."""
    df = settled(df.select("pixel_id", "lat_idx", "lon_idx", Y, P))
    per = settled(pixel_metrics(df))
    metrics = ["r2", "rmse", "mae"]
    return {
        "metrics": fit_metrics(df), "pixels": per, "summary": metrics_summary(per), "density": density_hex(df, Y, P), "error_bins": error_bins(df),
        **{f"map_{m}": metric_map(pixels, per, m, base) for m in metrics}, **{f"hist_{m}": histogram(per, m) for m in metrics}, **{f"stats_{m}": t for m, t in stats_of(per, metrics).items()},
    }


def observation_bundle(df: DataFrame) -> dict[str, DataFrame]:
    """All tables behind the plots of an evaluation by observation, over predictions that are
    written once to a scratch folder."""
    df = settled(df.select("pixel_id", "lat_idx", "lon_idx", "time", Y, P))
    errors = with_errors(df)
    return {
        "metrics": fit_metrics(df), "by_time": observation_metrics_by_time(df), "pixels": pixel_observations(df), "error_bins": error_bins(df), "residual_bins": residual_bins(df),
        "ape": ape_histogram(df), "hist_residual": histogram(errors, "residual"), "stats_residual": value_stats(errors, "residual"), "density": density_hex(df, Y, P),
    }


def quantile_edges(df: DataFrame, value: str, n: int) -> list[float]:
    """The distinct edges of n bins of equal count; n numbers, exact."""
    return sorted(set(quantiles(df, value, [i / n for i in range(n + 1)]).get(None, [])))


#: Aggregates that differ by less than this share are equal: sums in another order differ by so much.
ROUNDING = 1e-12


def bin_of(value: str, edges: list[float], rounding: float = 0.0) -> Column:
    """The bin's number: right-closed, the lowest edge in the first; NULL outside. What is above an
    edge by no more than the share ``rounding`` is at it."""
    c = F.col(value)
    number = F.lit(0)
    for e in edges[1:-1]:
        number = number + F.when(c > e + abs(e) * rounding, 1).otherwise(0)
    inside = c.between(edges[0] - abs(edges[0]) * rounding, edges[-1] + abs(edges[-1]) * rounding) if edges else None
    return F.when(inside, number) if len(edges) > 1 else F.lit(None).cast("int")


def binned_summary(df: DataFrame, value: str, metric: str = "r2", bins: int = 8) -> DataFrame:
    """Of bins of equal count of ``value``, an aggregate as ``metric`` is: their size and means. The rows are
    written once to a scratch folder, since sums are not the same each time they are made, and
    values that are equal but for the order of a sum share a bin."""
    df = settled(df.select(value, metric))
    edges: list[float] = []
    for e in quantile_edges(df, value, bins):
        if not edges or e > edges[-1] + abs(e) * ROUNDING:
            edges.append(e)
    dealt = df.withColumn("bin", bin_of(value, edges, ROUNDING)).where("bin IS NOT NULL")
    middle = df.sparkSession.createDataFrame([(g, q[0]) for g, q in quantiles(dealt, metric, [0.5], "bin").items()], "bin int, median double")
    return dealt.groupBy("bin").agg(F.count(metric).alias("n"), F.avg(value).alias("mean_value"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std")).join(middle, "bin", "left")


def error_bins(df: DataFrame, bins: int = 12, least: float = 1e-6) -> DataFrame:
    """Errors by quantile of the truth; infinite truths are left out."""
    known = df.where((F.col(Y) > least) & all_finite(Y))
    edges = quantile_edges(known, Y, bins)
    ape = F.abs(F.col(P) - F.col(Y)) / F.col(Y) * 100
    return known.withColumn("bin", bin_of(Y, edges)).groupBy("bin").agg(_n(), F.avg(Y).alias("mean_true"), mae(Y, P).alias("mae"), F.avg(ape).alias("mape"))


def residual_bins(df: DataFrame, edges: int = 20, top: float = 0.995, least: int = 10) -> DataFrame:
    """Mean residual over bins of equal width up to a high quantile of the truth; one bin
    where that is the least truth, none without rows."""
    lo, hi = quantiles(df, Y, [0.0, top]).get(None, (0.0, 0.0))
    if lo == hi:
        return df.where(F.col(Y) == lo).groupBy(F.lit(0).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(P) - F.col(Y)).alias("mean_residual")).where(F.col("n") >= least)
    width = (hi - lo) / (edges - 1)
    number = F.floor((F.col(Y) - lo) / width).cast("int")
    return df.where(F.col(Y) < hi).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(P) - F.col(Y)).alias("mean_residual")).where(F.col("n") >= least)


def ape_histogram(df: DataFrame, bins: int = 20, top: float = 0.99, least: float = 1e-6) -> DataFrame:
    """Counts of absolute percentage errors up to a high quantile; all in one bin where that
    is 0, none without rows."""
    ape = df.where(F.abs(Y) > least).select((F.abs(F.col(P) - F.col(Y)) / F.abs(Y) * 100).alias("ape"))
    hi = quantile(ape, "ape", top) or 0.0
    if hi == 0:
        return ape.where(F.col("ape") == 0).groupBy(F.lit(0).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return ape.where(F.col("ape") <= hi).groupBy(F.least(F.floor(F.col("ape") / (hi / bins)).cast("int"), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width counts over the range of the finite values; where that is a single value it
    stands in the middle one of bins over half a unit to either side."""
    known = df.where(all_finite(value))
    lo, hi = known.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return known.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    width = (hi - lo) / bins
    return known.groupBy(F.least(F.floor((F.col(value) - lo) / width).cast("int"), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, x: str, y: str, width: float, height: float) -> DataFrame:
    """Counts over boxes, and their logarithm."""
    boxes = df.where(all_finite(x, y)).groupBy(F.floor(F.col(x) / width).cast("int").alias("bx"), F.floor(F.col(y) / height).cast("int").alias("by"))
    return boxes.agg(F.count(F.lit(1)).alias("n")).withColumn("log_n", F.log10("n"))


def density_hex(df: DataFrame, x: str, y: str, columns: int = 60, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``hx, hy, n, log_n``: counts over hexagons, ``columns`` of them side by side, over the range of the
    finite values or ``bounds`` (x from and to, y from and to). The hexagons' centres are two lattices of boxes, the second
    offset by half a box both ways, and a point goes to the nearer of the centres next to it,
    where a step up counts for three times a step aside; a tie goes to the first lattice. ``hx`` and
    ``hy`` are the centre's place in half boxes, so that those of the second lattice are odd."""
    known = df.where(all_finite(x, y))
    if bounds is None:
        bounds = tuple(known.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first())
    if bounds[0] is None:
        return known.select(*(F.lit(0).alias(c) for c in ("hx", "hy")), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("log_n")).limit(0)
    x0, x1, y0, y1 = bounds
    rows = max(int(columns / 3**0.5), 1)
    width, height = (x1 - x0) / columns or 1.0, (y1 - y0) / rows or 1.0
    a, b = (F.col(x) - x0) / width, (F.col(y) - y0) / height
    first = [F.floor(c + 0.5) for c in (a, b)]
    second = [F.least(F.floor(c), F.lit(n - 1)) for c, n in ((a, columns), (b, rows))]
    near = lambda u, v: (a - u) * (a - u) + 3.0 * (b - v) * (b - v)
    odd = near(*first) > near(second[0] + 0.5, second[1] + 0.5)
    place = [F.when(odd, 2 * t + 1).otherwise(2 * s).cast("int") for s, t in zip(first, second, strict=True)]
    hexagons = known.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1)).groupBy(place[0].alias("hx"), place[1].alias("hy"))
    return hexagons.agg(F.count(F.lit(1)).alias("n")).withColumn("log_n", F.log10("n"))


def label_codes(df: DataFrame, mask: DataFrame, labels: DataFrame, code: str = "code") -> DataFrame:
    """Adds the mask's code by pixel and its label; what has none is Unknown."""
    out = df.join(mask.select("pixel_id", code).dropDuplicates(["pixel_id"]), "pixel_id", "left").join(labels.select(code, "label"), code, "left")
    return out.withColumn("label", F.coalesce("label", F.lit("Unknown")))


def metric_map(pixels: DataFrame, metrics: DataFrame, value: str, base: str | None = None) -> DataFrame:
    """A metric on all pixels: 0 on the base mask where there is none, else NULL."""
    ground = F.when(F.col(base), 0.0) if base else F.lit(None).cast("double")
    return pixels.join(metrics.select("pixel_id", F.col(value).alias("__v")), "pixel_id", "left").select("pixel_id", F.coalesce("__v", ground).alias(value))


def worst_row(df: DataFrame, keys: list[str]) -> DataFrame:
    return with_errors(df).orderBy(F.desc_nulls_last("abs_error"), *keys).limit(1)
