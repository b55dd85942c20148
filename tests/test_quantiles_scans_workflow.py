import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.quantiles import quantile, quantiles
from gridloom.operators import cube as C
from gridloom.operators import evaluate as E
from gridloom.operators import explain, model
from gridloom.plans import workflow
from gridloom.sources import cube as SC


@pytest.mark.parametrize("few", [0, 10**6])
def test_quantiles_against_numpy(spark, few):
    rng = random.Random(4)
    groups = {
        "spread": [rng.gauss(0, 10 ** rng.uniform(-3, 6)) for _ in range(3000)],
        "ties": [float(rng.choice([1, 1, 1, 2, 50])) for _ in range(2000)],
        "one": [7.5],
        "flat": [3.0] * 40,
        "wide": [-1e308, 1e308, 0.0, 5e-324, 1.0],
    }
    odd = [("odd", None), ("odd", float("nan")), ("odd", float("inf")), ("one", float("-inf"))]
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + odd, "g string, v double")
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.95, 1.0]
    got = quantiles(df, "v", probs, "g", few)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        if g != "wide":  # numpy's difference of the extremes overflows
            assert got[g] == pytest.approx(np.quantile(vs, probs).tolist(), rel=1e-9, abs=1e-12)
    assert (got["wide"][0], got["wide"][4], got["wide"][6]) == (-1e308, 5e-324, 1e308)
    assert quantiles(df.where("g = 'flat'"), "v", [0.5], few=few) == {None: [3.0]}
    assert quantile(df.limit(0), "v", 0.5) is None


def predictions(spark, rows):
    return spark.createDataFrame(rows, "pixel_id long, time date, lat_idx int, lon_idx int, y_true double, y_pred double")


def test_bins_of_no_rows_and_of_right_predictions(spark):
    none = predictions(spark, [])
    assert E.residual_bins(none).count() == E.ape_histogram(none).count() == E.error_bins(none).count() == E.binned_summary(E.pixel_metrics(none), "y_variance").count() == 0
    same = predictions(spark, [(1, None, 0, 0, 2.0, 2.0)] * 12)
    assert [tuple(r) for r in E.ape_histogram(same).collect()] == [(0, 12)]
    assert [tuple(r) for r in E.residual_bins(same).collect()] == [(0, 12, 0.0)]
    stats = E.value_stats(E.pixel_metrics(none), "rmse").first()
    assert stats.n == 0 and stats.median is None
    assert all(df.columns for df in (E.spatial_bundle(none, none) | E.observation_bundle(none)).values())


def test_labels_and_metric_map_without_match(spark):
    pixels = spark.createDataFrame([(1, 0, True), (2, 9, True), (3, None, False)], "pixel_id long, code int, keep boolean")
    labels = spark.createDataFrame([(0, "a"), (4, "b")], "code int, label string")
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,)], "pixel_id long")
    assert {r.pixel_id: r.label for r in E.label_codes(rows, pixels, labels).collect()} == {1: "a", 2: "Unknown", 3: "Unknown", 4: "Unknown"}
    metrics = spark.createDataFrame([(1, 0.5)], "pixel_id long, r2 double")
    assert {r.pixel_id: r.r2 for r in E.metric_map(pixels, metrics, "r2", "keep").collect()} == {1: 0.5, 2: 0.0, 3: None}
    assert {r.label for r in SC.labels_of(spark, "/nowhere", "climate").collect()} >= {"Tropical", "Polar"}


def long_cube(spark, n_pixels=6, n_time=24):
    rng = random.Random(2)
    rows = [(v, t, f"{2000 + t // 12}-{t % 12 + 1:02d}-01", p, rng.random() if (p + t) % 9 else None) for v in ("LAI", "TP", "SM") for p in range(n_pixels) for t in range(n_time)]
    return spark.createDataFrame(rows, "variable string, time_idx int, time string, pixel_id long, value double").withColumn("time", F.to_date("time"))


def test_scans_raise_where_there_is_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/cube"
    SC.write_cube(long_cube(spark), path)
    with pytest.raises(ValueError, match="no variable"):
        SC.read_variable(spark, path, "XY")
    with pytest.raises(KeyError):
        SC.read_cube(spark, path, ["XY"])
    long_cube(spark).drop("time").write.partitionBy("variable").parquet(f"{path}2")
    with pytest.raises(ValueError, match="lacks"):
        SC.read_variable(spark, f"{path}2", "LAI")
    grid = spark.createDataFrame([(1, 10.0, 20.0)], "pixel_id long, lat double, LON double")
    assert SC.standard_axes(grid).columns == ["pixel_id", "latitude", "longitude"]
    with pytest.raises(ValueError, match="no cell"):
        SC.select_roi(SC.standard_axes(grid), {"lat_min": -10, "lat_max": 0, "lon_min": 0, "lon_max": 50})
    with pytest.raises(ValueError):
        SC.only_value(grid, ["pixel_id"])
    assert SC.only_value(grid, ["pixel_id", "lat"]) == "LON"
    cells = spark.createDataFrame([(2, 0)], "pixel_id long, time_idx int")
    with pytest.raises(IndexError):
        SC.with_coordinates(cells, SC.standard_axes(grid), spark.createDataFrame([(0, "x")], "time_idx int, time string"))
    with pytest.raises(FileNotFoundError):
        SC.read_files(spark, path, "nothing*")
    with pytest.raises(ValueError, match="no row"):
        E.target_year(predictions(spark, [(1, None, 0, 0, 1.0, 1.0)]), 1999)


def test_a_lagged_scan_reads_no_more_years_than_it_needs(spark, tmp_path):
    path = f"file://{tmp_path}/cube"
    cube = long_cube(spark)
    SC.write_cube(cube, path)
    got = SC.read_variable(spark, path, "TP_LAG_3", start_year=2001, end_year=2001)
    want = {(r.pixel_id, r.time_idx + 3): r.value for r in cube.where("variable = 'TP'").collect()}
    rows = got.collect()
    assert len(rows) == 6 * 12 and all(r.value == want.get((r.pixel_id, r.time_idx)) for r in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time_" in plan and "variable" in plan.split("PartitionFilters")[1][:80]


def test_shapes_and_metadata_of_either_form(spark):
    cube = long_cube(spark).where("variable = 'LAI'")
    SC.check_shape(cube, 6, 24)
    with pytest.raises(ValueError, match="expected"):
        SC.check_shape(cube.where("time_idx > 0"), 6, 24)
    entry = {"LAI": {"path": "a"}}
    assert SC.variables_of({"variables": entry, "grid": {}}) == SC.variables_of(entry | {"grid": {"n": 1}, "step": 1}) == entry


def test_products_are_read_back_and_undone(spark, tmp_path):
    cube = long_cube(spark).where("variable = 'LAI'").drop("variable")
    done = C.preprocess(cube, "value", value_type="anomaly", detrended=True)
    assert done.steps == ["anomaly", "detrend"] and C.preprocess(cube, "value").steps == []
    done.save(f"file://{tmp_path}/p")
    back = {(r.pixel_id, r.time_idx): r.value for r in C.reconstruct(C.Preprocessed.load(spark, f"file://{tmp_path}/p"), "value").collect()}
    for r in cube.collect():
        assert (back[r.pixel_id, r.time_idx] is None) == (r.value is None) and (r.value is None or math.isclose(back[r.pixel_id, r.time_idx], r.value, abs_tol=1e-9))


def test_shapley_against_all_subsets(spark, tmp_path):
    rng = random.Random(6)
    rows = spark.createDataFrame([(a := rng.random(), b := rng.random(), c := rng.random(), a * 2 + b * c) for _ in range(300)], "a double, b double, c double, y double")
    fitted = model.train(rows, ["a", "b", "c"], "rf", numTrees=4, maxDepth=4)
    forest = explain.leaves(fitted, f"file://{tmp_path}/forest")
    x = np.array([[rng.random() for _ in range(3)] for _ in range(5)])

    def known(row, subset):  # what the forest says where only a subset is known
        total = 0.0
        for leaf in forest:
            part = leaf.value
            for j, lo, hi, share in zip(leaf.features, leaf.low, leaf.high, leaf.share, strict=True):
                part *= (lo < row[j] <= hi) if j in subset else share
            total += part
        return total

    got = explain.shapley(x, forest)
    for i, row in enumerate(x):
        for j in range(3):
            others = [k for k in range(3) if k != j]
            want = sum(math.factorial(n) * math.factorial(2 - n) / 6 * (known(row, {*s, j}) - known(row, set(s))) for n in range(3) for s in itertools.combinations(others, n))
            assert got[i, j] == pytest.approx(want)


def test_classes_or_regression(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 2.0), (3, 1.0)], "y_true long, y_pred double")
    r = model.fit_report(rows).first()
    assert (r.n, r.accuracy, r.recall) == (4, 0.5, 0.5) and r.precision == pytest.approx((2 * 0.5 + 1 * 0.5 + 0) / 4)
    assert "rmse" in model.fit_report(rows.withColumn("y_true", F.col("y_true") * 1.5)).columns
