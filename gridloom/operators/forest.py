"""A random forest trained on the sums of its cells; the model is pyspark.ml's.

A forest cuts each feature into bins, so rows of equal bins are alike to every tree. Where there are
no more such cells than rows, one pass draws how often each row is in each tree's bootstrap sample and
sums that by cell; what comes after no longer hangs on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.stats import is_finite
from gridloom.sources.scratch import scratch

#: So many sums (of three numbers) a task holds, one for each tree and cell.
SUMS = 1 << 23
#: For fewer draws, one for each tree and row, pyspark.ml is as quick.
DRAWS = 1 << 23
#: Rows that a task draws for at once.
DRAWN = 1 << 16
#: A cut's rank is right to one part of so many.
ACCURACY = 10_000
#: Gains below this share of the label's variance are what rounding leaves.
ROUNDING = 1e-14
SUBSETS = {"all": lambda p: p, "sqrt": lambda p: int(np.ceil(np.sqrt(p))), "onethird": lambda p: -(-p // 3)}


class Forest(RandomForestRegressor):
    """``RandomForestRegressor`` with its parameters, that sums cells where they are few.

    A tree is drawn by the same rules: row by row a bootstrap sample, at each node a random subset of the
    features, of their cuts that of the greatest gain. The cuts are quantiles of all rows, where pyspark.ml
    takes those of a sample. With more cells, few draws, weights, categories or other subsets pyspark.ml trains."""

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        get, features, subset = self.getOrDefault, dataset.schema[self.getFeaturesCol()], self._subset()
        kinds = features.metadata.get("ml_attr", {}).get("attrs", {})
        if subset not in SUBSETS or get("minWeightFractionPerNode") or self.isDefined("weightCol") or {"nominal", "binary"} & kinds.keys():
            return super()._fit(dataset)
        x, y = vector_to_array(F.col(f"`{features.name}`")), F.col(f"`{self.getLabelCol()}`").cast("double")
        seen = dataset.agg(F.min(F.size(x)), F.max(F.size(x)), F.count(F.lit(1)), F.count_if(is_finite(y)), F.avg(y)).first()
        p, n, cells = seen[0], seen[2], get("maxBins") ** (seen[0] or 0)
        if not p or seen[1] != p or seen[3] < n or n < cells or n * get("numTrees") < DRAWS or get("numTrees") * cells > SUMS:
            return super()._fit(dataset)
        names = [f"x{i}" for i in range(p)]
        rows = dataset.select(*(x[i].alias(c) for i, c in enumerate(names)), y.alias("y"))
        cuts, mean = cuts_of(rows, names, get("maxBins")), seen[4]
        sums = bagged(rows, cuts, mean, get("numTrees"), get("subsamplingRate"), get("bootstrap"), get("seed") % 2**32)
        return self._model(dataset.sparkSession, sums, cuts, mean)

    def _subset(self) -> str:
        named = self.getOrDefault("featureSubsetStrategy")
        return named if named != "auto" else "all" if self.getOrDefault("numTrees") == 1 else "onethird"

    def _model(self, spark, sums: DataFrame, cuts: list[list[float]], mean: float) -> RandomForestRegressionModel:
        """The trees, written as pyspark.ml saves a forest: that of one row, whose nodes they replace."""
        get, folder = self.getOrDefault, scratch(spark)
        p, seed = len(cuts), get("seed") % 2**32
        rules = (SUBSETS[self._subset()](p), get("maxDepth"), get("minInstancesPerNode"), get("minInfoGain"))

        def one(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(b).reshape(3, -1) for b in parts["sums"])
            nodes = grow(total, cuts, mean, *rules, np.random.default_rng([seed, key[0], 1]))
            return pd.DataFrame([(key[0], *node) for node in nodes], columns=["tree", *NODE])

        types = ", ".join(["tree int", *(f"`{k}` {t}" for k, t in NODE.items())])
        found = sums.groupBy("tree").applyInPandas(one, types)
        cut = F.when(F.col("feature") < 0, F.array().cast("array<double>")).otherwise(F.array("cut"))
        split = F.struct("feature", cut, F.lit(-1))
        node = F.struct("id", "prediction", "impurity", "stats", "n", "gain", "left", "right", split)
        row = spark.createDataFrame([(Vectors.dense([0.0] * p), 0.0)], [self.getFeaturesCol(), self.getLabelCol()])
        super()._fit(row).write().save(folder)
        form = spark.read.parquet(f"{folder}/data").schema
        found.select(F.col("tree").cast(form["treeID"].dataType).alias("treeID"), node.cast(form["nodeData"].dataType).alias("nodeData")).write.mode("overwrite").parquet(f"{folder}/data")
        return self._copyValues(RandomForestRegressionModel.load(folder))


def cuts_of(rows: DataFrame, names: list[str], bins: int) -> list[list[float]]:
    """Of each feature the middles between its values, or where there are more of them than bins, quantiles."""
    probs = [k / bins for k in range(1, bins)]
    first = rows.agg(*(F.struct(F.approx_count_distinct(c).alias("n"), F.percentile_approx(c, probs, ACCURACY).alias("q")).alias(c) for c in names)).first()
    few = [c for c in names if first[c].n <= 2 * bins]
    sets = rows.agg(*(F.collect_set(c).alias(c) for c in few)).first() if few else {}
    out = []
    for c in names:
        v = np.unique(sets[c]) if c in few else np.array([])
        cuts = (v[:-1] + v[1:]) / 2 if 0 < len(v) <= bins else np.unique(first[c].q)
        out.append(cuts[np.isfinite(cuts)].tolist())
    return out


def bagged(rows: DataFrame, cuts: list[list[float]], mean: float, trees: int, rate: float, bootstrap: bool, seed: int) -> DataFrame:
    """``tree, sums``: of each tree's sample the count, the sum and the sum of squares of the labels less
    ``mean`` by cell; a row a tree of each task, however many rows it reads."""
    names, sizes = [f"x{i}" for i in range(len(cuts))], [len(c) + 1 for c in cuts]
    cells = int(np.prod(sizes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng, sums = np.random.default_rng([seed, TaskContext.get().partitionId(), 0]), None
        for b in _joined(batches):
            sums = np.zeros((trees, 3, cells)) if sums is None else sums
            cell = np.ravel_multi_index([np.searchsorted(c, b[n].to_numpy()) for n, c in zip(names, cuts, strict=True)], sizes)
            y = b["y"].to_numpy() - mean
            squares = y * y
            for t in range(trees):
                if bootstrap:  # as many of the rows at random as is one Poisson number: one for each row
                    times = np.bincount(rng.integers(0, len(y), rng.poisson(rate * len(y))), minlength=len(y))
                else:
                    times = rng.random(len(y)) < rate
                for k, v in enumerate((times, times * y, times * squares)):
                    sums[t, k] += np.bincount(cell, v, cells)
        for t in range(trees if sums is not None else 0):
            yield pd.DataFrame({"tree": [t], "sums": [sums[t].tobytes()]})

    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "tree int, sums binary")


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of some ``DRAWN`` rows."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= DRAWN:
            yield pd.concat(held)
            held = []
    if sum(map(len, held)):
        yield pd.concat(held)


NODE = {"id": "int", "prediction": "double", "impurity": "double", "stats": "array<double>", "n": "long", "gain": "double", "left": "int", "right": "int", "feature": "int", "cut": "double"}


def grow(sums: np.ndarray, cuts: list[list[float]], mean: float, subset: int, depth: int, least: int, least_gain: float, rng: np.random.Generator) -> list[tuple]:
    """The nodes of a tree, ``NODE`` of each, a node before its children; leaves of equal prediction are one."""
    here = np.flatnonzero(sums[0])
    sizes = [len(c) + 1 for c in cuts]
    at, (n, s, q) = np.array(np.unravel_index(here, sizes)), sums[:, here]
    rounding = ROUNDING * (q.sum() / max(n.sum(), 1))
    nodes: list[tuple] = []

    def best(some: np.ndarray) -> tuple[float, int, int]:
        of_n, of_s, top = n[some], s[some], (0.0, -1, -1)
        total, whole = of_n.sum(), of_s.sum()
        for f in rng.permutation(len(sizes))[:subset]:
            left, moved = (np.bincount(at[f, some], v, sizes[f]).cumsum()[:-1] for v in (of_n, of_s))
            ok = np.flatnonzero((left >= max(least, 1)) & (total - left >= max(least, 1)))
            left, moved = left[ok], moved[ok]
            gains = (moved**2 / left + (whole - moved) ** 2 / (total - left) - whole**2 / total) / total
            if len(ok) and gains.max() > max(top[0], rounding) and gains.max() >= least_gain:
                top = (float(gains.max()), int(f), int(ok[gains.argmax()]))
        return top

    def add(some: np.ndarray, level: int) -> int:
        i, (a, b, c) = len(nodes), (v[some].sum() for v in (n, s, q))
        m = b / a if a else 0.0
        stats = [a, b + a * mean, c + 2 * mean * b + a * mean**2]
        known = (i, m + mean, max(c / a - m * m, 0.0) if a else 0.0, stats, int(a))
        nodes.append((*known, -1.0, -1, -1, -1, 0.0))
        gain, f, k = best(some) if level < depth and a else (0.0, -1, -1)
        if f >= 0:
            low = at[f, some] <= k
            left, right = add(some[low], level + 1), add(some[~low], level + 1)
            if nodes[left][6] < 0 and nodes[right][6] < 0 and nodes[left][1] == nodes[right][1]:
                del nodes[left:]
            else:
                nodes[i] = (*known, gain, left, right, f, cuts[f][k])
        return i

    add(np.arange(len(here)), 0)
    return nodes
