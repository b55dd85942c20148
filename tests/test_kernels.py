"""Slopes, perceptron, hexagons, resampling and arrays against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from gridloom.functions import quantiles as Q
from gridloom.functions.slopes import inversions, median_slope
from gridloom.operators import cube as C
from gridloom.operators import evaluate as E
from gridloom.operators import explain, forest, model, perceptron
from gridloom.sources import npy


def plain_slope(x, y):
    s = [(y[j] - y[i]) / (x[j] - x[i]) for i in range(len(x)) for j in range(len(x)) if x[j] > x[i]]
    return float(np.median(s)) if s else 0.0


@pytest.mark.parametrize("few", [512, 0])
def test_median_slopes(few):
    rng = np.random.default_rng(1)
    assert [inversions(np.array(r)) for r in ([0], [1, 0], [2, 1, 0], [0, 1, 2, 3], [3, 0, 2, 1])] == [0, 1, 3, 0, 4]
    for n in (0, 1, 2, 3, 7, 50, 121):
        for kind in range(4):
            x = rng.permutation(n).astype(float) if kind % 2 else np.floor(rng.uniform(0, n / 3 + 1, n))
            y = rng.normal(0, 100, n) if kind < 2 else np.floor(rng.normal(0, 2, n))
            assert median_slope(x, y, few) == pytest.approx(plain_slope(x, y), rel=1e-9, abs=1e-9), (n, kind)


def test_long_series_take_the_memory_of_their_length():
    import tracemalloc

    rng = np.random.default_rng(2)
    x, y = np.arange(2000.0), rng.normal(0, 1, 2000) + np.arange(2000) * 0.01
    tracemalloc.start()
    slope = median_slope(x, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 * 100 * 8 * 20 and slope == pytest.approx(0.01, abs=1e-3)


def test_series_of_pixels(spark):
    rng = random.Random(3)
    rows = [(p, t, f"{2000 + t // 12}-{t % 12 + 1:02d}-01", rng.random() * (p + 1) if (t + p) % 5 else None) for p in range(4) for t in range(40)]
    df = spark.createDataFrame([*rows, (9, 0, "2000-01-01", 1.0), (8, 0, "2000-01-01", None)], "pixel_id int, time_idx int, time string, v double").withColumn("time", F.to_date("time"))
    got = {r.pixel_id: r.slope for r in C.theil_sen(df, "v").collect()}
    day = {r.time_idx: (r.time.toordinal()) / 365.2425 for r in df.collect()}
    for p in range(4):
        own = [(day[t], v) for q, t, _, v in rows if q == p and v is not None]
        assert got[p] == pytest.approx(plain_slope(*zip(*own, strict=True)), rel=1e-6)
    assert got[9] == got[8] == 0.0


def test_quantiles_take_two_scans(spark, monkeypatch):
    calls = []
    for name in ("_sketch", "_count", "_inside"):
        f = getattr(Q, name)
        monkeypatch.setattr(Q, name, lambda *a, f=f, name=name: (calls.append(name), f(*a))[1])
    df = spark.createDataFrame([(i % 2, float(np.sin(i) * i), 0.0 if i % 5 < 2 else float(np.exp(i % 997 / 20)), 3.0, float(i % 7)) for i in range(60_000)], "g int, a double, b double, c double, d double")
    x = {g: df.where(f"g = {g}").toPandas() for g in (0, 1)}
    probs = [0, 0.01, 1 / 3, 0.5, 0.95, 0.995, 1]
    for few, keep, scans in ((10**6, 10**5, 2), (100, 10**5, 2), (100, 5, 4)):
        calls.clear()
        got = Q.quantiles_of(df, list("abcd"), probs, "g", few, keep)
        for v in "abcd":
            for g in (0, 1):
                assert got[v][g] == pytest.approx(np.quantile(x[g][v], probs).tolist(), rel=1e-9, abs=1e-12)
        assert len(calls) == scans or scans == 4 < len(calls) < 12, calls


def test_perceptron_gradient_and_fit(spark, tmp_path):
    rng = np.random.default_rng(4)
    sizes = [3, 5, 4, 1]
    w, x, y = perceptron.first_weights(sizes, 1), rng.normal(0, 1, (20, 3)), rng.normal(0, 1, 20)
    loss, gradient = perceptron.loss_and_gradient(x, y, w, sizes)
    for k in rng.choice(len(w), 15, replace=False):
        step = np.zeros(len(w))
        step[k] = 1e-6
        up, down = (perceptron.loss_and_gradient(x, y, w + s * step, sizes)[0] for s in (1, -1))
        assert gradient[k] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)
    rows = spark.createDataFrame([(*map(float, a), bool(h), float(b)) for a, b, h in zip(x, y, np.arange(20) % 4 == 0, strict=True)], "a double, b double, c double, held boolean, y double").repartition(3)
    got = perceptron.totals(rows.select(F.array("a", "b", "c").alias("x"), "y", "held"), w, sizes)
    kept = np.arange(20) % 4 != 0
    plain = perceptron.loss_and_gradient(x[kept], y[kept], w, sizes)
    assert got[0] == 15 and got[2] == 5 and got[1] == pytest.approx(plain[0]) and got[4:] == pytest.approx(plain[1])
    data = spark.createDataFrame([(float(a), float(b), float(30 + 10 * a * a + 5 * b)) for a, b in rng.uniform(-1, 1, (800, 2))], "a double, b double, y double").repartition(2)
    fitted = model.train(data, ["a", "b"], "mlp", "standard", layers=[12], maxIter=60)
    model.save_run(fitted, {}, f"file://{tmp_path}/m")
    said = model.predict(model.load_run(f"file://{tmp_path}/m"), data)
    assert E.global_metrics(said).first().r2 > 0.97
    one = VectorAssembler(inputCols=["a"], outputCol="features").transform(data.limit(1))
    assert perceptron.Perceptron(labelCol="y", layers=[2], maxIter=2).fit(one).transform(one).count() == 1
    with pytest.raises(ValueError, match="no rows"):
        perceptron.Perceptron(labelCol="y").fit(one.limit(0))


def test_hexagons_go_to_the_nearest_centre(spark):
    rng = random.Random(5)
    points = [(rng.uniform(0, 50), rng.gauss(3, 9)) for _ in range(400)] + [(None, 1.0), (float("inf"), 1.0)]
    df = spark.createDataFrame(points, "x double, y double")
    got = {(r.hx, r.hy): r.n for r in E.density_hex(df, "x", "y", 12).collect()}
    known = points[:400]
    x0, x1, y0, y1 = min(p[0] for p in known), max(p[0] for p in known), min(p[1] for p in known), max(p[1] for p in known)
    w, h = (x1 - x0) / 12, (y1 - y0) / int(12 / 3**0.5)
    want = {}
    for px, py in known:
        a, b = (px - x0) / w, (py - y0) / h
        centres = [(i, j) for i in range(-2, 28) for j in range(-2, 18) if i % 2 == j % 2]
        best = min(centres, key=lambda c: ((a - c[0] / 2) ** 2 + 3 * (b - c[1] / 2) ** 2, c[0] % 2))
        want[best] = want.get(best, 0) + 1
    assert got == want
    assert E.density_hex(df.limit(0), "x", "y").count() == 0
    assert E.density_hex(df.where("x = 1e9").unionByName(spark.createDataFrame([(2.0, 2.0)] * 3, "x double, y double")), "x", "y").first().n == 3


def test_resampling_takes_the_nearest_point(spark):
    rng = random.Random(6)
    points = [(rng.uniform(-3, 13), rng.uniform(-3, 13), float(i)) for i in range(60)] + [(None, 1.0, 5.0), (5.0, 5.0, None), (100.0, 100.0, 1.0)]
    grid = [(i, j, i * 1.0, j * 1.0) for i in range(11) for j in range(11)]
    got = C.resample_nearest(spark.createDataFrame(points, "latitude double, longitude double, v double"), "v", spark.createDataFrame(grid, "lat_idx int, lon_idx int, latitude double, longitude double"), 1.0, -1.0)
    for r in got.collect():
        own = [(round((a - r.lat_idx) ** 2 + (b - r.lon_idx) ** 2, 9), a, b, v) for a, b, v in points if None not in (a, b, v) and abs(np.floor(a + 0.5) - r.lat_idx) <= 1 and abs(np.floor(b + 0.5) - r.lon_idx) <= 1]
        assert r.v == (min(own)[3] if own else -1.0)


def test_resampling_hashes_distances_and_breaks_ties(spark, monkeypatch):
    """Ties go south, west, then to the least value; no plan sorts all points in a task to find a cell's least."""
    points = spark.createDataFrame([(x, y, v) for x, y in ((1.25, 1.0), (0.75, 1.0), (1.0, 0.75)) for v in (3.0, 2.0)], "latitude double, longitude double, v double")
    grid = spark.createDataFrame([(1, 1, 1.0, 1.0), (1, 2, 1.0, 2.0)], "lat_idx int, lon_idx int, latitude double, longitude double")
    for limit in (C.BROADCAST_CELLS, 0):
        monkeypatch.setattr(C, "BROADCAST_CELLS", limit)
        got = C.resample_nearest(points, "v", grid, 1.0)
        assert {(r.lat_idx, r.lon_idx): r.v for r in got.collect()} == {(1, 1): 2.0, (1, 2): 2.0}
    plan = C.resample_nearest(points, "v", grid, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "min(struct(d" not in plan
    empty = grid.limit(0)
    assert C.resample_nearest(points, "v", empty, 1.0).count() == 0


def test_arrays_are_written_read_and_cut(spark, tmp_path):
    rng = random.Random(7)
    cells = [(t, i, j, rng.random() if (t + i + j) % 4 else None) for t in range(30) for i in range(4) for j in range(5) if (t, i) != (7, 2)]
    df = spark.createDataFrame(cells, "time_idx int, lat_idx int, lon_idx int, v double").repartition(3)
    path = f"file://{tmp_path}/cube"
    npy.write_npy(df, "v", path, 4, 5, steps=8, dtype="float64")
    assert sorted(p.name for p in (tmp_path / "cube").glob("*.npy")) == [f"t{t:09d}.npy" for t in (0, 8, 16, 24)]
    whole = np.concatenate([np.load(p) for p in sorted((tmp_path / "cube").glob("*.npy"))])
    want = {(t, i, j): v for t, i, j, v in cells if v is not None}
    assert whole.shape == (30, 4, 5) and all(whole[k] == v for k, v in want.items()) and np.isfinite(whole).sum() == len(want)
    back = npy.read_npy(spark, path, 4, 5, 30)
    assert {(r.time_idx, r.lat_idx, r.lon_idx): r.value for r in back.collect() if r.value is not None} == want and back.count() == 600
    some = back.where("time_idx >= 9 AND time_idx < 12")
    assert some.count() == 60 and some.rdd.getNumPartitions() == 2 - 1
    with pytest.raises(ValueError, match="shape"):
        npy.read_npy(spark, path, 5, 4)
    np.save(tmp_path / "mask.npy", np.eye(3, dtype=np.int8))
    mask = npy.read_npy(spark, f"file://{tmp_path}/mask.npy", 3, 3)
    assert mask.agg(F.sum("value")).first()[0] == 3.0
    with pytest.raises(FileNotFoundError):
        npy.read_npy(spark, f"file://{tmp_path}/nothing.npy")
    with pytest.raises(ValueError, match="outside"):
        npy.write_npy(df, "v", f"file://{tmp_path}/small", 2, 2)


def test_the_worst_row_names_its_features(spark):
    rows = spark.createDataFrame([(1, 0, 0.5, 1.0, 0.1, -0.7), (2, 0, 3.0, 2.0, -0.2, 0.1), (3, 0, float("nan"), 9.0, 9.0, 9.0)], "pixel_id int, time_idx int, abs_error double, a double, shap_a double, shap_b double").withColumn("b", F.col("a") * 2)
    assert [(r.pixel_id, r.feature, r["rank"]) for r in explain.worst_row(rows, ["a", "b"]).orderBy("rank").collect()] == [(2, "a", 1), (2, "b", 2)]


def test_shapley_in_blocks_is_the_sum_over_leaves():
    rng = np.random.default_rng(3)

    def leaf(d):
        low = rng.normal(size=d) - 1
        return explain.Leaf(np.sort(rng.choice(5, d, replace=False)), low, low + 2, rng.uniform(0.1, 1, d), rng.normal())

    forest = [leaf(d) for d in rng.integers(0, 6, 3 * explain.LEAVES + 5)]
    x = rng.normal(size=(explain.ROWS + 7, 5))
    x[3, 2] = np.nan
    one_by_one = sum(explain.shapley(x, [leaf]) for leaf in forest)
    np.testing.assert_allclose(explain.shapley(x, forest), one_by_one, atol=1e-9)
    assert not explain.shapley(x, []).any() and not explain.shapley(x, [leaf(0)]).any()
    assert explain.shapley(x[:0], forest).shape == (0, 5)


def test_forest_of_cells_is_the_forest_of_rows(spark, monkeypatch, tmp_path):
    """Without drawing, the trees of pyspark.ml; with it, samples of as many rows and as good a forest, in jobs whose number does not grow with depth."""
    monkeypatch.setattr(forest, "DRAWS", 0)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 7, (3000, 2))
    y = x[:, 0] * (x[:, 1] - 2.5) + rng.normal(0, 1, 3000)
    data = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double").repartition(3).cache()
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data)
    told = lambda m: [re.sub(r"(?<=Predict: ).*", lambda v: f"{float(v[0]):.9f}", line) for line in m.toDebugString.split("\n")[1:]]
    plain = {"labelCol": "y", "predictionCol": "y_pred", "seed": -5, "maxBins": 16}
    for least, depth in ((1, 6), (40, 4)):
        whole = {**plain, "numTrees": 2, "bootstrap": False, "featureSubsetStrategy": "all", "maxDepth": depth, "minInstancesPerNode": least}
        got, want = forest.Forest(**whole).fit(rows), RandomForestRegressor(**whole).fit(rows)
        assert told(got) == told(want) and got.totalNumNodes > 20
        assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray())
        got.write().save(f"file://{tmp_path}/{least}")
        rawly = spark.read.parquet(f"file://{tmp_path}/{least}/data").select("nodeData.*").where("id = 0").first()
        assert rawly.rawCount == 3000 and rawly.impurityStats == pytest.approx([3000, y.sum(), (y * y).sum()])
    jobs = []
    for depth in (3, 8):
        spark.sparkContext.setJobGroup(f"forest {depth}", "")
        fitted = model.train(data, ["a", "b"], "rf", numTrees=40, maxDepth=depth, maxBins=16)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest {depth}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    said = {"cells": fitted, "rows": model.pipeline(["a", "b"], RandomForestRegressor(**plain, numTrees=40, maxDepth=8, featureSubsetStrategy="sqrt")).fit(data)}
    r2 = {k: E.global_metrics(model.predict(m, data)).first().r2 for k, m in said.items()}
    assert r2["cells"] == pytest.approx(r2["rows"], abs=0.01) and r2["cells"] > 0.9
    fitted.stages[-1].write().save(f"file://{tmp_path}/drawn")
    roots = [r.rawCount for r in spark.read.parquet(f"file://{tmp_path}/drawn/data").select("nodeData.*").where("id = 0").collect()]
    assert len(set(roots)) > 20 and all(abs(r - 3000) < 5 * 3000**0.5 for r in roots)
    leaves = explain.leaves(fitted, f"file://{tmp_path}/again")
    off = explain.explain(model.predict(fitted, data), ["a", "b"], leaves).where(F.abs(F.col("shap_a") + F.col("shap_b") + explain.base_value(leaves) - F.col("y_pred")) > 1e-6)
    assert off.isEmpty()
