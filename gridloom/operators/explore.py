"""Exploration: structure, univariate statistics, correlation families, dominance.

Where several predictors are asked about, one aggregation answers for all: the grouping
is shuffled once and the answers are unpivoted after it, not the cells before it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.quantiles import quantiles_of
from gridloom.functions.stats import is_finite, kurtosis, pair, safe_corr, safe_divide, skewness

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def temporal_map(df: DataFrame, value: str) -> DataFrame:
    """Mean, population standard deviation and missing share of each pixel."""
    return df.groupBy("pixel_id").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.avg(F.col(value).isNull().cast("int")).alias("nan_fraction"))


def spatial_series(df: DataFrame, value: str) -> DataFrame:
    """Unweighted mean and population standard deviation of each step."""
    return df.groupBy("time_idx", "time").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def monthly_climatology(df: DataFrame, value: str) -> DataFrame:
    """The spatial mean's mean by calendar month."""
    return spatial_series(df, value).groupBy(F.month("time").alias("month")).agg(F.avg("mean").alias("mean"))


def spatial_anomaly(df: DataFrame, value: str) -> DataFrame:
    """The spatial mean minus its mean of the calendar month."""
    w = Window.partitionBy(F.month("time"))
    return spatial_series(df, value).withColumn("anomaly", F.col("mean") - F.avg("mean").over(w)).select("time_idx", "time", "anomaly")


def _each(variables: list[str], make) -> Column:
    """An array of one struct per variable, to be exploded after the aggregation."""
    return F.array(*[F.struct(F.lit(v).alias("variable"), *make(v)) for v in variables])


def overview(df: DataFrame, variables: list[str]) -> DataFrame:
    stats = _each(variables, lambda v: [F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col(v).isNull()).alias("n_missing"), F.avg(F.col(v).isNull().cast("int") * 100.0).alias("missing_percent"), F.min("time").alias("time_min"), F.max("time").alias("time_max")])
    return df.agg(stats.alias("s")).select(F.explode("s").alias("s")).select("s.*")


def structure_report(df: DataFrame, variables: list[str]) -> DataFrame:
    """Finite and infinite counts, and steps and pixels without any value."""
    inf = float("inf")
    counts = df.agg(_each(variables, lambda v: [F.count_if(is_finite(v)).alias("n_finite"), F.count_if(F.col(v) == inf).alias("n_posinf"), F.count_if(F.col(v) == -inf).alias("n_neginf")]).alias("s"))

    def empty(key: str, name: str) -> DataFrame:
        per = df.groupBy(key).agg(*[F.bool_and(F.col(v).isNull()).alias(v) for v in variables])
        return per.agg(_each(variables, lambda v: [F.count_if(F.col(v)).alias(name)]).alias("s")).select(F.explode("s").alias("s")).select("s.*")

    head = counts.select(F.explode("s").alias("s")).select("s.*")
    return head.join(empty("time_idx", "n_empty_steps"), "variable").join(empty("pixel_id", "n_empty_pixels"), "variable")


def missing_summary(df: DataFrame, variables: list[str]) -> DataFrame:
    """The largest and the mean missing share of a step."""
    per = df.groupBy("time_idx").agg(*[F.avg(F.col(v).isNull().cast("int")).alias(v) for v in variables])
    return per.agg(_each(variables, lambda v: [F.max(v).alias("max_missing"), F.avg(v).alias("mean_missing")]).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def univariate(df: DataFrame, variables: list[str]) -> DataFrame:
    """Exact moments and quantiles of the finite values."""

    def stats(v: str) -> list[Column]:
        x = F.when(is_finite(v), F.col(v))
        return [
            F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
            (F.max(x) - F.min(x)).alias("range"), safe_divide(F.stddev_pop(x), F.avg(x)).alias("cv"), skewness(v).alias("skewness"), kurtosis(v).alias("kurtosis"),
        ]

    moments = df.agg(_each(variables, stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    names = [f"p{round(p * 100):02d}" for p in QUANTILES]
    found = quantiles_of(df, variables, list(QUANTILES))
    table = df.sparkSession.createDataFrame([(v, *q[None]) for v, q in found.items() if None in q], f"variable string, {', '.join(f'{n} double' for n in names)}")
    return moments.join(table, "variable", "left").withColumn("iqr", F.col("p75") - F.col("p25"))


def correlations(df: DataFrame, target: str, predictors: list[str], by: list[str | Column] = (), min_n: int = 2) -> DataFrame:
    """``by..., predictor, r`` of the target with each predictor, in each group."""
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(p).alias("predictor"), safe_corr(target, p, min_n).alias("r")) for i, p in enumerate(predictors)])
    out = df.groupBy(*by).agg(rows.alias("s")) if by else df.agg(rows.alias("s"))
    keys = [c for c in out.columns if c != "s"]
    return out.select(*keys, F.explode("s").alias("s")).select(*keys, "s.*")


def correlation_table(df: DataFrame, target: str, predictors: list[str]) -> DataFrame:
    """Ranked by strength."""
    w = Window.orderBy(F.desc_nulls_last(F.abs("r")), "place")
    return correlations(df, target, predictors).withColumn("rank", F.row_number().over(w)).select("predictor", "r", "rank")


def correlation_matrix(df: DataFrame, variables: list[str], triangle: str | None = None, diagonal: bool = True) -> DataFrame:
    """``a, b, r`` pairwise complete; each pair is aggregated once."""
    n = len(variables)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), safe_corr(variables[i], variables[j]).alias("r")) for i, j in pairs])
    half = df.agg(rows.alias("s")).select(F.explode("s").alias("s")).select("s.*")
    full = half.unionByName(half.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    names = F.array(*[F.lit(v) for v in variables])
    full = full.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "i", "j", "r")
    if triangle:
        inside = F.col("i") >= F.col("j") if triangle == "lower" else F.col("i") <= F.col("j")
        full = full.where(inside if diagonal else inside & (F.col("i") != F.col("j")))
    return full.select("a", "b", "r")


def vif(df: DataFrame, variables: list[str]) -> DataFrame:
    """``variable, r2, vif`` over complete rows: the diagonal of the inverse correlation
    matrix, whose k by k numbers one aggregation brings to the driver."""
    ok = reduce(lambda a, b: a & b, [is_finite(v) for v in variables])
    rows = df.where(ok)
    k = len(variables)
    cells = rows.agg(*[safe_corr(variables[i], variables[j]) for i in range(k) for j in range(k)]).first()
    r = np.array([np.nan if c is None else c for c in cells]).reshape(k, k)
    out = []
    for i, v in enumerate(variables):
        if np.isnan(r[i, i]):
            out.append((v, None, None))
            continue
        others = [j for j in range(k) if j != i and not np.isnan(r[j, j])]
        share = float(r[i, others] @ np.linalg.pinv(r[np.ix_(others, others)]) @ r[others, i]) if others else 0.0
        out.append((v, share, float("inf") if share >= 1 else 1 / (1 - share)))
    return df.sparkSession.createDataFrame(out, "variable string, r2 double, vif double")


def lagged_correlations(df: DataFrame, target: str, predictors: list[str], steps: list[int], by: list[str | Column] = ()) -> DataFrame:
    """``by..., predictor, lag, r`` of the target with each predictor k steps earlier."""
    from gridloom.operators.cube import lags

    wide = lags(df, predictors, steps)
    names = [f"{p}_LAG_{k}" for p in predictors for k in steps]
    out = correlations(wide, target, names, by)
    parts = F.col("predictor")
    return out.withColumns({"lag": F.regexp_extract(parts, r"_LAG_(\d+)$", 1).cast("int"), "predictor": F.regexp_replace(parts, r"_LAG_\d+$", "")}).drop("place")


def _strength() -> Column:
    """What correlations are ranked by: below six digits they differ by the order of the sums, as of
    two pairs, which correlate by 1 or -1 whatever they are."""
    return F.round(F.abs("r"), 6)


def best_lag(df: DataFrame, target: str, predictors: list[str], steps: list[int]) -> DataFrame:
    """The lag of the strongest correlation of each predictor, the first among equals to six digits."""
    found = lagged_correlations(df, target, predictors, steps)
    w = Window.partitionBy("predictor").orderBy(F.desc_nulls_last(_strength()), "lag")
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def pivot(df: DataFrame, rows: list[str], column: str, values: list, value: str = "r") -> DataFrame:
    """A table with one column per value, such as predictors by month."""
    return df.groupBy(*rows).pivot(column, values).agg(F.first(value))


def spatial_correlation_summary(df: DataFrame, target: str, predictors: list[str]) -> DataFrame:
    """Over steps: mean, sample deviation, extremes and share above 0 (NULL is not)."""
    per = correlations(df, target, predictors, ["time_idx"])
    positive = F.avg(F.coalesce(F.col("r") > 0, F.lit(False)).cast("int"))
    return per.groupBy("predictor").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.min("r").alias("min"), F.max("r").alias("max"), positive.alias("positive_fraction"))


def strongest(found: DataFrame, by: list[str]) -> DataFrame:
    """The predictor of the largest absolute correlation of each group, the first listed
    among equals to six digits; merged before the shuffle. Groups without any have NULL and code 0."""
    key = F.struct(_strength().alias("s"), (-F.col("place")).alias("o"), "predictor", "r")
    best = found.groupBy(*by).agg(F.max(F.when(F.col("r").isNotNull(), key)).alias("b"))
    return best.select(*by, F.col("b.predictor").alias("predictor"), F.col("b.r").alias("r"), F.coalesce(-F.col("b.o") + 1, F.lit(0)).alias("dominant_code"))


def dominant_map(df: DataFrame, target: str, predictors: list[str]) -> DataFrame:
    return strongest(correlations(df, target, predictors, ["pixel_id"]), ["pixel_id"])


def dominant_by_category(df: DataFrame, target: str, predictors: list[str], code: str = "code") -> DataFrame:
    return strongest(correlations(df, target, predictors, [code]), [code])


def paint(pixels: DataFrame, table: DataFrame, code: str = "code", value: str = "dominant_code") -> DataFrame:
    """Each pixel its category's value, 0 where the category has none."""
    return pixels.select("pixel_id", code).join(table.select(code, value), code, "left").select("pixel_id", F.coalesce(value, F.lit(0)).alias(value))


def dominance(df: DataFrame, target: str, predictors: list[str]) -> DataFrame:
    """How often each predictor is the strongest over steps."""
    best = strongest(correlations(df, target, predictors, ["time_idx"]), ["time_idx"]).where("predictor IS NOT NULL")
    n = best.groupBy("predictor").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def category_summary(df: DataFrame, labels: DataFrame, value: str, code: str = "code", ignore: tuple[int, ...] = (0,)) -> DataFrame:
    """Sizes and missing values of each labelled category, zero where it has no pixel."""
    per = df.groupBy("pixel_id", code).agg(F.count(F.lit(1)).alias("cells"), F.count(value).alias("values"))
    per = per.groupBy(code).agg(F.count(F.lit(1)).alias("n_pixels"), F.count_if(F.col("values") > 0).alias("n_valid_pixels"), F.sum("cells").alias("n_total_values"), (F.sum("cells") - F.sum("values")).alias("n_missing"))
    out = labels.where(~F.col(code).isin(list(ignore))).join(per, code, "left").fillna(0, ["n_pixels", "n_valid_pixels", "n_total_values", "n_missing"])
    return out.withColumn("missing_percent", safe_divide(F.col("n_missing") * 100.0, F.col("n_total_values")))


def pixel_sample(df: DataFrame, value: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` pixels that have any value, in a repeatable random order."""
    from gridloom.functions.stats import stable_order

    some = df.groupBy("pixel_id").agg(F.count(value).alias("n")).where("n > 0")
    return some.select("pixel_id").orderBy(stable_order(seed, "pixel_id")).limit(n)


def joint_moments(df: DataFrame, a: str, b: str) -> DataFrame:
    """Sums over finite pairs, from which correlations of merged groups follow."""
    x, y = pair(a, b)
    return df.groupBy("pixel_id").agg(F.count(x).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
