"""Shapley values of tree models, and what is read from them.

The path-dependent values of a forest are sums over its leaves: a leaf whose path tests d
features gives each of them a share that depends only on which tests the row passes and on
the share of training rows that passed. Rows are explained by the cells that the forest's cuts
make, a batch of cells at a time in ``mapInPandas``; the tree table is as large as the model, not as the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.split import head_sample, stratified_sample
from gridloom.sources.cube import save_json


#: Rows and leaves of a block, whose arrays stay in a core's cache.
ROWS, LEAVES = 256, 32


@dataclass(frozen=True)
class Leaf:
    """The tested features, per feature the open interval (low, high] that the path allows
    and the share of training rows that stay in it, and the leaf's weighted value."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float


def leaves(model: PipelineModel, folder: str) -> list[Leaf]:
    """The leaves of a fitted forest, read from the model as Spark saves it."""
    forest = model.stages[-1]
    forest.write().overwrite().save(folder)
    node = SparkSession.active().read.parquet(f"{folder}/data").select("treeID", "nodeData.*")
    cut = F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("cut")
    nodes = node.select("treeID", "id", "prediction", "rawCount", "leftChild", "rightChild", "split.featureIndex", cut).toArrow().sort_by([("treeID", "ascending"), ("id", "ascending")])
    trees, prediction, count, left, right, feature, cuts = (nodes[c].to_numpy() for c in nodes.column_names if c != "id")
    weights = list(forest.treeWeights)
    if type(forest).__name__.startswith("RandomForest"):
        weights = [1 / len(weights)] * len(weights)
    out: list[Leaf] = []
    for root in np.flatnonzero(np.diff(trees, prepend=-1)):  # a tree's nodes are numbered from 0
        stack = [(root, {})]
        while stack:
            at, path = stack.pop()
            if left[at] < 0:
                f = sorted(path)
                out.append(Leaf(np.array(f, int), *(np.array([path[j][i] for j in f]) for i in range(3)), float(prediction[at]) * weights[trees[at]]))
                continue
            j, cut = int(feature[at]), float(cuts[at])
            low, high, share = path.get(j, (-np.inf, np.inf, 1.0))
            for child, bounds in ((root + left[at], (low, min(high, cut))), (root + right[at], (max(low, cut), high))):
                stack.append((child, path | {j: (*bounds, share * float(count[child] / count[at]))}))
    return out


@dataclass(frozen=True)
class Stack:
    """Leaves that test equally many features, one in a row of each array."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def stacked(forest: list[Leaf]) -> list[Stack]:
    """The forest as a few arrays, which are what tasks are sent; leaves without tests move nothing."""
    by_size: dict[int, list[Leaf]] = {}
    for leaf in forest:
        by_size.setdefault(len(leaf.features), []).append(leaf)
    names = [f.name for f in fields(Stack)]
    return [Stack(*(np.array([getattr(leaf, n) for leaf in some]) for n in names)) for d, some in sorted(by_size.items()) if d]


def shapley(x: np.ndarray, forest: list[Leaf] | list[Stack]) -> np.ndarray:
    """One value per row and feature, in a leaf's depth squared, for blocks of leaves and rows.

    A leaf's tests make a polynomial, the product over its features of share + inside * t,
    whose coefficients weigh the sets of known features by their number. It is extended feature by
    feature once, and each feature is unwound from it by a division: where the row is inside,
    from the highest coefficient down, all features at once; elsewhere by the share."""
    out = np.zeros(x.shape)
    stacks = stacked(forest) if forest and isinstance(forest[0], Leaf) else forest
    for s, r in ((s, r) for s in stacks for r in range(0, len(x), ROWS)):
        for k in range(0, len(s.value), LEAVES):
            out[r : r + ROWS] += _moved(x[r : r + ROWS], Stack(*(getattr(s, f.name)[k : k + LEAVES] for f in fields(s))))
    return out


def _moved(x: np.ndarray, s: Stack) -> np.ndarray:
    """What a block of leaves moves; arrays are by feature of a leaf, leaf and row."""
    at = s.features.T
    d = len(at)
    low, high, share = (a.T[:, :, None] for a in (s.low, s.high, s.share))
    v = x.T[at]
    inside = ((v > low) & (v <= high)).astype(float)
    e = np.zeros((d + 1, *v.shape[1:]))
    e[0] = 1
    for k in range(d):
        e[1 : k + 2] = e[1 : k + 2] * share[k] + e[: k + 1] * inside[k]
        e[0] *= share[k]
    weight = np.array([factorial(n) * factorial(d - 1 - n) / factorial(d) for n in range(d)])
    left = np.broadcast_to(e[d], inside.shape)
    known = weight[d - 1] * left
    for n in range(d - 1, 0, -1):
        left = e[n] - share * left
        known = known + weight[n - 1] * left
    outside = np.tensordot(weight, e[:d], 1)[None] / share
    moved = s.value[None, :, None] * (inside - share) * np.where(inside > 0, known, outside)
    of = (np.arange(x.shape[1])[:, None] == at.ravel()).astype(float)
    return (of @ moved.reshape(-1, len(x))).T


def base_value(forest: list[Leaf]) -> float:
    """What is predicted when nothing is known: the value of the empty set."""
    return float(sum(leaf.value * np.prod(leaf.share) for leaf in forest))


def _cell_of(value: Column, cuts: list[float]) -> Column:
    """How many cuts are below the value; what passes no test, as no number, is in cell -1."""
    v = value.cast("double")
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < v)) if cuts else F.lit(0)
    return F.when(v.isNull() | F.isnan(v) | (v == float("-inf")), -1).otherwise(below)


def explain(rows: DataFrame, predictors: list[str], forest: list[Leaf], parts: int | None = None) -> DataFrame:
    """The rows with ``shap_<predictor>``; they add up to prediction minus base.

    Rows that are between the same cuts of the forest in every predictor pass the same tests, so
    each such cell is explained once and its rows get its values by a join: a cell costs as much as
    the forest has leaves, and a forest of three predictors in 32 bins has 32,768 cells, however many
    rows there are. The cells are dealt to ``parts`` tasks, as many as the cluster runs at once unless given."""
    added = [f"shap_{p}" for p in predictors]
    names, stacks = rows.withColumns({a: F.lit(0.0) for a in added}).columns, stacked(forest)
    cuts: list[set[float]] = [set() for _ in predictors]
    for s in stacks:
        for bounds in (s.low, s.high):
            for j in np.unique(s.features):
                cuts[j] |= set(np.unique(bounds[(s.features == j) & np.isfinite(bounds)]).tolist())
    keys = [f"__cell_{i}" for i in range(len(predictors))]
    dealt = rows.drop(*added).withColumns({k: _cell_of(F.col(p), sorted(c)) for k, p, c in zip(keys, predictors, cuts, strict=True)})
    some = [f"__some_{i}" for i in range(len(predictors))]  # any value of the cell stands for it
    cells = dealt.groupBy(*keys).agg(*(F.min(F.col(p).cast("double")).alias(v) for p, v in zip(predictors, some, strict=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[added] = shapley(b[some].to_numpy(float), stacks)
            yield b[keys + added]

    schema = ", ".join([*(f"{k} int" for k in keys), *(f"`{a}` double" for a in added)])
    values = cells.repartition(parts or rows.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, schema)
    return dealt.join(values, keys).select(*(f"`{n}`" for n in names))


def worst_row(explained: DataFrame, predictors: list[str], error: str = "abs_error", keys: tuple[str, ...] = ("pixel_id", "time_idx")) -> DataFrame:
    """``keys..., feature, value, shap, rank`` of the row of largest error: its features by what they
    moved the prediction, most first. An error that is no number counts least; where errors
    are equal, the first by ``keys``."""
    e = F.col(error).try_cast("double")
    worst = explained.orderBy(F.coalesce(F.when(~F.isnan(e), e), F.lit(float("-inf"))).desc(), *keys).limit(1)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("feature"), F.col(p).cast("double").alias("value"), F.col(f"shap_{p}").alias("shap")) for p in predictors]))
    rows = worst.select(*keys, each.alias("s")).select(*keys, "s.*")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("shap")), "feature")))


def importance(explained: DataFrame, predictors: list[str], by: str | None = None, least: int = 1) -> DataFrame:
    """Mean absolute value per feature, over all rows or per group of enough rows."""
    means = F.array(*[F.struct(F.lit(p).alias("feature"), F.avg(F.abs(f"shap_{p}")).alias("mean_abs_shap")) for p in predictors])
    groups = explained.groupBy(*([by] if by else [])).agg(means.alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return groups.select(*([by] if by else []), "n", F.explode("s").alias("s")).select(*([by] if by else []), "n", "s.*")


def run(rows: DataFrame, model: PipelineModel, predictors: list[str], folder: str, group: str | None = None, keys: tuple[str, ...] = ("pixel_id", "time_idx"), max_per_group: int = 1000, max_total: int = 5000, fraction: float = 0.5, least: int = 30, seed: int = 42) -> dict[str, DataFrame]:
    """Explains a stratified sample of the rows and writes ``values``, ``importance`` and, with
    a ``group``, ``by_group`` below ``folder``, with a summary; groups of fewer than ``least``
    rows have no importance of their own."""
    spark = rows.sparkSession
    sample = stratified_sample(rows, group, list(keys), max_per_group, fraction, max_total, seed) if group else head_sample(rows, list(keys), max_total, seed)
    forest = leaves(model, f"{folder}/forest")
    explain(sample, predictors, forest, spark.sparkContext.defaultParallelism).write.mode("overwrite").parquet(f"{folder}/values")
    values = spark.read.parquet(f"{folder}/values")
    if values.isEmpty():
        raise ValueError("no rows were chosen to be explained")
    out = {"values": values, "importance": importance(values, predictors)}
    if group:
        out["by_group"] = importance(values, predictors, group, least)
    for name in out.keys() - {"values"}:
        out[name].coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}")
    save_json(spark, {"n_rows": values.count(), "base_value": base_value(forest), "predictors": predictors, "group": group, "seed": seed}, f"{folder}/summary")
    return out
