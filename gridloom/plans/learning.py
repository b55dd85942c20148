"""Queries that train models; their results are beyond SQL.

They show the operators, not a model worth having: 10 trees of depth 5 against the library's
defaults of 200 of depth 10, 5 rounds of boosting, 3 draws in 3 folds. ``shap_adds_up`` takes
the default forest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import evaluate, explain, model, split
from gridloom.sources.cube import load_json
from gridloom.sources.fixtures import PREDICTORS, VARIABLES, cube, pixels
from gridloom.sources.scratch import scratch


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table, written once: each pass of a training reads it again."""
    c = cube(spark, sf_dir)
    path = scratch(spark)
    split.training_table(c, "target", PREDICTORS, split.observation_split(c, VARIABLES, 1.0, 0.2)).write.parquet(path)
    return spark.read.parquet(path)


def _metrics(spark: SparkSession, sf_dir: str, name: str, **params) -> DataFrame:
    table = rows(spark, sf_dir)
    fitted = model.train(table.where("split = 'train'"), PREDICTORS, name, **params)
    predicted = model.predict(fitted, table)
    train = evaluate.global_metrics(predicted.where("split = 'train'")).withColumn("split", F.lit("train"))
    return train.unionByName(evaluate.global_metrics(predicted.where("split = 'test'")).withColumn("split", F.lit("test")))


def rf_predict_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "rf", numTrees=10, maxDepth=5)


def gbt_predict_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "hgb", maxIter=5, maxDepth=3)


def mlp_predict_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "mlp", scaler="standard", layers=[16], maxIter=15)


def cv_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = split.folds(rows(spark, sf_dir), 3, group="pixel_id")
    return model.search(table, PREDICTORS, {"numTrees": [3, 5], "maxDepth": [2, 4]}, 3)[1]


def shap_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rows(spark, sf_dir)
    fitted = model.train(table.where("split = 'train'"), PREDICTORS, "rf", numTrees=5, maxDepth=4)
    forest = explain.leaves(fitted, f"{scratch(spark)}/forest")
    return explain.importance(explain.explain(table.where("split = 'test'"), PREDICTORS, forest), PREDICTORS)


def shap_adds_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All test rows explained with the default forest, and how many whose values and base are not the prediction."""
    table = rows(spark, sf_dir)
    fitted = model.train(table.where("split = 'train'"), PREDICTORS, "rf")
    forest = explain.leaves(fitted, f"{scratch(spark)}/forest")
    found = explain.explain(model.predict(fitted, table.where("split = 'test'")), PREDICTORS, forest, spark.sparkContext.defaultParallelism)
    off = F.abs(sum((F.col(f"shap_{p}") for p in PREDICTORS), F.lit(explain.base_value(forest))) - F.col("y_pred"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_if((off > 1e-6) | off.isNull()).alias("n_off"))


def shap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole explanation run over a sample by region, read back from its files."""
    table, folder = rows(spark, sf_dir).join(pixels(spark, sf_dir).select("pixel_id", "label"), "pixel_id"), scratch(spark)
    fitted = model.train(table.where("split = 'train'"), PREDICTORS, "rf", numTrees=5, maxDepth=4)
    explain.run(model.predict(fitted, table), fitted, PREDICTORS, folder, "label", least=1)
    groups = spark.read.csv(f"{folder}/by_group", header=True, schema="label string, n long, feature string, mean_abs_shap double")
    total = load_json(spark, f"{folder}/summary")["n_rows"]
    return groups.where("mean_abs_shap IS NOT NULL").groupBy("label", "n").agg(F.count("feature").alias("n_features")).withColumn("n_rows", F.lit(total).cast("long"))


QUERIES = {f.__name__: f for f in (rf_predict_metrics, gbt_predict_metrics, mlp_predict_metrics, cv_search, shap_importance, shap_adds_up, shap_groups)}
