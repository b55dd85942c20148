"""The star-schema test tables seen as a cube and as predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.cube import densify

VARIABLES = ["target", "qty", "disc", "tax"]
PREDICTORS = ["qty", "disc", "tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pixels, their regions as categories, their balance as a mask."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("s_suppkey").alias("pixel_id"),
        F.floor(F.col("s_suppkey") / 10).cast("int").alias("lat_idx"),
        (F.col("s_suppkey") % 10).cast("int").alias("lon_idx"),
        F.col("n_regionkey").alias("code"),
        F.col("r_name").alias("label"),
        (F.col("s_acctbal") > 0).alias("keep"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int")
    return table(spark, sf_dir, "lineitem").withColumn("time_idx", step)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _lines(spark, sf_dir)
        .groupBy(F.col("l_suppkey").alias("pixel_id"), "time_idx")
        .agg(F.avg("l_extendedprice").alias("target"), F.avg("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"))
    )


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel by month, dense, with one column per variable."""
    time = F.make_date(F.lit(1995) + F.floor(F.col("time_idx") / 12).cast("int"), F.col("time_idx") % 12 + 1, F.lit(1))
    return densify(cells(spark, sf_dir), pixels(spark, sf_dir), _lines(spark, sf_dir)).withColumn("time", time)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as predicted observations of their supplier's pixel."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("pixel_id"),
        F.floor(F.col("l_suppkey") / 10).cast("int").alias("lat_idx"),
        (F.col("l_suppkey") % 10).cast("int").alias("lon_idx"),
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("time"),
        F.col("l_extendedprice").alias("y_true"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("y_pred"),
    )
