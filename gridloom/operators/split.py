"""Validity masks, exact-count splits, folds, samples and the training table.

Order is a hash of the seed and the row's ids, so splits repeat on any cluster; sizes are
exact, with halves rounded to even. Global ranks come from counts per hash range, so no
row set is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.stats import all_finite, stable_order


def valid_pixels(df: DataFrame, variables: list[str], min_fraction: float = 0.0) -> DataFrame:
    """``pixel_id, valid``: any complete step, or at least that share of them."""
    share = F.avg(all_finite(*variables).cast("int"))
    return df.groupBy("pixel_id").agg(((share > 0) if min_fraction <= 0 else (share >= min_fraction)).alias("valid"))


def valid_observations(df: DataFrame, variables: list[str], min_fraction: float = 0.0) -> DataFrame:
    """The complete cells of valid pixels."""
    ok = all_finite(*variables)
    if min_fraction <= 0:  # a pixel with a complete cell is valid
        return df.where(ok)
    share = F.avg(ok.cast("int")).over(Window.partitionBy("pixel_id"))
    return df.withColumn("__share", share).where(ok & (F.col("__share") >= min_fraction)).drop("__share")


def sample_sizes(n: Column, train_fraction: float, test_fraction: float) -> tuple[Column, Column]:
    """How many are selected, and how many of those are for the test."""
    if not (0 < train_fraction <= 1 and 0 < test_fraction < 1):
        raise ValueError("fractions must satisfy 0 < train <= 1 and 0 < test < 1")
    chosen = n if train_fraction >= 1 else F.greatest(F.lit(1), F.bround(n * F.lit(float(train_fraction))).cast("long"))
    wanted = F.greatest(F.lit(1), F.bround(chosen * F.lit(float(test_fraction))).cast("long"))
    return chosen, F.when(chosen <= 1, 0).otherwise(F.least(wanted, chosen - 1))


def ranked(df: DataFrame, seed: int, ids: list[str], by: list[str] = ()) -> DataFrame:
    """Adds ``rank``, from 1 in hash order (within ``by``), and ``total``.

    A rank is the number of rows in the hash ranges before, which are counted first, plus
    the place in its own range, so windows hold one range and not the whole."""
    h = stable_order(seed, *ids)
    rows = df.withColumn("__h", h).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "total": F.sum("__n").over(Window.partitionBy(*by))}).drop("__n")
    place = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", *ids))
    return rows.join(counts, [*by, "__b"]).withColumn("rank", F.col("__before") + place).drop("__h", "__b", "__before")


def split_ids(ids: DataFrame, keys: list[str], train_fraction: float, test_fraction: float, seed: int) -> DataFrame:
    """``keys, split``: train, test, or NULL where not selected."""
    chosen, test = sample_sizes(F.col("total"), train_fraction, test_fraction)
    r = ranked(ids.select(*keys), seed, keys)
    return r.withColumn("split", F.when(F.col("rank") <= test, "test").when(F.col("rank") <= chosen, "train")).drop("rank", "total")


def spatial_split(df: DataFrame, variables: list[str], train_fraction: float = 1.0, test_fraction: float = 0.1, seed: int = 42, min_fraction: float = 0.0) -> DataFrame:
    """Whole pixels are train or test."""
    pixels = valid_pixels(df, variables, min_fraction).where("valid")
    return split_ids(pixels, ["pixel_id"], train_fraction, test_fraction, seed)


def observation_split(df: DataFrame, variables: list[str], train_fraction: float = 1.0, test_fraction: float = 0.1, seed: int = 42, min_fraction: float = 0.0) -> DataFrame:
    """Single cells are train or test."""
    rows = valid_observations(df, variables, min_fraction)
    return split_ids(rows, ["pixel_id", "time_idx"], train_fraction, test_fraction, seed)


SPLITS = {"spatial_pixel": spatial_split, "random_observation": observation_split}


def split_stats(split: DataFrame) -> DataFrame:
    return split.agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.count("split").alias("n_selected"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.count_distinct(F.when(F.col("split") == "train", F.col("pixel_id"))).alias("n_train_pixels"),
        F.count_distinct(F.when(F.col("split") == "test", F.col("pixel_id"))).alias("n_test_pixels"),
    )


def training_table(df: DataFrame, target: str, predictors: list[str], split: DataFrame) -> DataFrame:
    """One row per complete cell that was selected, with its place and split."""
    keys = [k for k in ("pixel_id", "time_idx") if k in split.columns]
    rows = df.where(all_finite(target, *predictors))
    return rows.join(split.where("split IS NOT NULL"), keys).select("split", "pixel_id", "lat_idx", "lon_idx", "time_idx", *predictors, F.col(target).alias("y"))


def table_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pixel_id").alias("n_pixels"), F.min("time_idx").alias("time_min"), F.max("time_idx").alias("time_max"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are in both; a sound split has none."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_semi")


def folds(df: DataFrame, k: int, seed: int = 42, keys: list[str] = ("pixel_id", "time_idx"), group: str | None = None) -> DataFrame:
    """Adds ``fold`` from 0 to k - 1, of even size; with ``group`` its rows stay together."""
    if k < 2:
        raise ValueError("at least two folds")
    on = [group] if group else list(keys)
    ids = ranked(df.select(*on).distinct(), seed, on)
    if group and ids.limit(k).count() < k:
        raise ValueError("fewer groups than folds")
    return df.join(ids.select(*on, ((F.col("rank") - 1) % k).cast("int").alias("fold")), on)


def stratified_sample(df: DataFrame, group: str, keys: list[str], max_per_group: int, fraction: float, cap: int, seed: int = 42) -> DataFrame:
    """``max_per_group`` rows of groups at least twice that large, else that fraction of
    the group, one at least; then at most ``cap`` rows over all."""
    r = ranked(df.where(F.col(group).isNotNull() & (F.col(group).cast("string") != "NoData")), seed, keys, [group])
    n = F.when(F.col("total") >= 2 * max_per_group, max_per_group).otherwise(F.greatest(F.lit(1), F.floor(F.col("total") * fraction)))
    some = r.where(F.col("rank") <= n).drop("rank", "total")
    return ranked(some, seed + 1, keys).where(F.col("rank") <= cap).drop("rank", "total")


def category_sample(df: DataFrame, category: str, keys: list[str], most: int = 2000, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each category, the first in hash order; the category is part
    of the hash, so samples of different categories are drawn apart. Rows without one are left out."""
    drawn = ranked(df.where(F.col(category).isNotNull()), seed, [category, *keys], [category])
    return drawn.where(F.col("rank") <= most).drop("rank", "total")


def head_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order."""
    return df.orderBy(stable_order(seed, *keys), *keys).limit(n)
