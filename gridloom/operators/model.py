"""Regression models on the training table, with pyspark.ml."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.quantiles import quantiles_of
from gridloom.functions.stats import all_finite, safe_divide
from gridloom.operators.evaluate import global_metrics
from gridloom.operators.forest import Forest
from gridloom.operators.perceptron import Perceptron
from gridloom.sources.cube import save_json

MODELS = {
    "rf": (Forest, {"numTrees": 200, "featureSubsetStrategy": "sqrt", "maxDepth": 10}),
    "hgb": (GBTRegressor, {"maxIter": 200, "stepSize": 0.1, "minInstancesPerNode": 20}),
    "mlp": (Perceptron, {"layers": [128, 64]}),
}


def build_model(name: str, seed: int = 42, **params):
    """A regressor by name, with its defaults overridden. ``rf`` is a random forest,
    ``hgb`` boosted trees over binned features, ``mlp`` a perceptron."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name}; there are {', '.join(MODELS)}")
    cls, defaults = MODELS[name]
    return cls(featuresCol="features", labelCol="y", predictionCol="y_pred", seed=seed, **(defaults | params))


def pipeline(predictors: list[str], model, scaler: str = "none") -> Pipeline:
    scalers = {
        "none": lambda: [],
        "standard": lambda: [StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)],
        "robust": lambda: [RobustScaler(inputCol="raw", outputCol="features", withCentering=True)],
    }
    if scaler not in scalers:
        raise ValueError(f"unknown scaler {scaler}")
    steps = scalers[scaler]()
    return Pipeline(stages=[VectorAssembler(inputCols=predictors, outputCol="raw" if steps else "features"), *steps, model])


def train(rows: DataFrame, predictors: list[str], name: str = "rf", scaler: str = "none", seed: int = 42, **params) -> PipelineModel:
    return pipeline(predictors, build_model(name, seed, **params), scaler).fit(rows)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with ``y_true`` and ``y_pred``; their place columns ride along."""
    out = model.transform(rows).withColumnRenamed("y", "y_true")
    return out.drop("raw", "features")


def search(rows: DataFrame, predictors: list[str], space: dict[str, list], draws: int, name: str = "rf", metric: str = "rmse", seed: int = 42, scaler: str = "none", fold: str = "fold", parallelism: int = 2) -> tuple[PipelineModel, DataFrame]:
    """Random search over ``space``, cross-validated on the given folds: the best model,
    refitted on all rows, and a table of parameters, mean and deviation of the metric."""
    model = build_model(name, seed)
    rng = random.Random(seed)
    maps = []
    for _ in range(draws):
        drawn = {model.getParam(k): rng.choice(v) for k, v in space.items()}
        if drawn not in maps:
            maps.append(drawn)
    k = rows.agg(F.max(fold)).first()[0] + 1
    cv = CrossValidator(estimator=pipeline(predictors, model, scaler), estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol="y", predictionCol="y_pred", metricName=metric), numFolds=k, foldCol=fold, seed=seed, parallelism=parallelism)
    fitted = cv.fit(rows)
    table = [(i, str({p.name: v for p, v in m.items()}), float(a), float(s)) for i, (m, a, s) in enumerate(zip(maps, fitted.avgMetrics, fitted.stdMetrics, strict=True))]
    results = rows.sparkSession.createDataFrame(table, f"draw int, params string, {metric}_mean double, {metric}_std double")
    return fitted.bestModel, results


def standard_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minus the mean, over the population deviation; one row of moments is joined."""
    moments = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"__{c}") for c in columns])
    out = df.crossJoin(F.broadcast(moments))
    return out.withColumns({c: safe_divide(F.col(c) - F.col(f"__{c}.m"), F.col(f"__{c}.s")) for c in columns}).drop(*[f"__{c}" for c in columns])


def robust_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minus the median, over the range of the middle half."""
    found = quantiles_of(df, columns, [0.25, 0.5, 0.75])
    q = lambda c, i: F.lit(found[c][None][i] if found[c] else None).cast("double")
    return df.withColumns({c: safe_divide(F.col(c) - q(c, 1), q(c, 2) - q(c, 0)) for c in columns})


def classification_metrics(df: DataFrame) -> DataFrame:
    """Accuracy, and precision, recall and F1 weighted by class size, of rounded predictions
    of whole-number truths; a class that is never predicted has precision 0."""
    rows = df.where(all_finite("y_true", "y_pred")).select(F.round("y_true").alias("t"), F.round("y_pred").alias("p"))
    cells = rows.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("k"), F.col("n").alias("truth"), F.lit(0).alias("said")), F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("truth"), F.col("n").cast("int").alias("said")))).alias("s"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    per = sides.groupBy("s.k").agg(F.sum("s.truth").alias("truth"), F.sum("s.said").alias("said"), (F.sum("hit") / 2).alias("hit"))
    precision, recall = F.coalesce(safe_divide(F.col("hit"), F.col("said")), F.lit(0.0)), F.coalesce(safe_divide(F.col("hit"), F.col("truth")), F.lit(0.0))
    f1 = F.coalesce(safe_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    per = per.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1)
    mean = lambda c: (F.sum(F.col("truth") * F.col(c)) / F.sum("truth")).alias(c)
    return per.agg(F.sum("truth").alias("n"), (F.sum("hit") / F.sum("truth")).alias("accuracy"), mean("precision"), mean("recall"), mean("f1"))


def fit_report(predicted: DataFrame, classes: int = 20) -> DataFrame:
    """Metrics of a fit: of classes where the truth is a whole-number column of few values,
    else of a regression."""
    whole = predicted.schema["y_true"].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and predicted.select("y_true").distinct().limit(classes + 1).count() <= classes:
        return classification_metrics(predicted)
    return global_metrics(predicted)


def write_csv(df: DataFrame, path: str, keys: list[str], limit: int = 20_000) -> None:
    """A small table as one CSV file: the first ``limit`` rows by ``keys``, NULL last as in SQL; rows of
    equal keys go by their other columns, so a cut between them is the same in every run."""
    order = [*keys, *(c for c in df.columns if c not in keys)]
    df.orderBy(*(F.asc_nulls_last(f"`{c}`") for c in order)).limit(limit).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def save_run(model: PipelineModel, info: dict, folder: str) -> None:
    model.write().overwrite().save(f"{folder}/model")
    save_json(SparkSession.active(), info, f"{folder}/train_info")


def load_run(folder: str) -> PipelineModel:
    return PipelineModel.load(f"{folder}/model")
