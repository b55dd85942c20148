import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import evaluate as E
from gridloom.operators import explain, model
from gridloom.operators import explore as X
from gridloom.operators import split as S
from gridloom.plans import catalogue
from gridloom.sources import cube as SC


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = []
    for p in range(20):
        for t in range(15):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append((p, t, p // 5, p % 5, a, b, a * 2 + rng.gauss(0, 0.1) if (p + t) % 7 else None))
    return spark.createDataFrame(rows, "pixel_id long, time_idx int, lat_idx int, lon_idx int, a double, b double, y double").cache()


def test_vif_of_dependent_variables(spark, table):
    got = {r.variable: r for r in X.vif(table.withColumn("c", F.col("a") + F.col("b")), ["a", "b", "c"]).collect()}
    assert got["c"].r2 == pytest.approx(1.0)
    plain = {r.variable: r for r in X.vif(table, ["a", "b"]).collect()}
    r = table.stat.corr("a", "b")
    assert plain["a"].vif == pytest.approx(1 / (1 - r * r))


def test_dominance_ties_take_the_first(spark):
    df = spark.createDataFrame([(0, float(i), float(i), float(-i)) for i in range(4)], "pixel_id long, y double, a double, b double")
    assert X.dominant_map(df, "y", ["a", "b"]).first()["predictor"] == "a"
    assert X.dominant_map(df, "y", ["b", "a"]).first()["predictor"] == "b"
    flat = df.withColumn("y", F.lit(1.0))
    assert tuple(X.dominant_map(flat, "y", ["a", "b"]).first()) == (0, None, None, 0)


def test_split_sizes_are_exact_and_disjoint(table):
    got = {r["split"]: r["n"] for r in S.observation_split(table, ["a", "b", "y"], 0.5, 0.25).groupBy("split").agg(F.count("*").alias("n")).collect()}
    n = table.where("y IS NOT NULL").count()
    chosen = round(n * 0.5)
    assert got["test"] == round(chosen * 0.25) and got["train"] == chosen - got["test"]
    s = S.spatial_split(table, ["a", "y"], 1.0, 0.1)
    assert s.where("split = 'test'").count() == 2 and s.where("split IS NULL").count() == 0
    assert S.overlap(s.where("split = 'train'"), s.where("split = 'test'"), ["pixel_id"]).isEmpty()


def test_half_even_sizes_and_bad_fractions(spark):
    ids = spark.range(5).select(F.col("id").alias("pixel_id"))
    assert S.split_ids(ids, ["pixel_id"], 0.5, 0.5, 1).where("split IS NOT NULL").count() == 2
    with pytest.raises(ValueError):
        S.split_ids(ids, ["pixel_id"], 0.0, 0.5, 1)
    assert S.split_ids(ids.limit(0), ["pixel_id"], 1.0, 0.5, 1).count() == 0


def test_ranks_are_a_permutation(spark):
    r = S.ranked(spark.range(3000).select(F.col("id").alias("pixel_id")), 3, ["pixel_id"])
    assert sorted(x["rank"] for x in r.collect()) == list(range(1, 3001))


def test_folds_keep_groups(table):
    f = S.folds(table, 4, group="pixel_id")
    assert f.groupBy("pixel_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    with pytest.raises(ValueError):
        S.folds(table, 30, group="pixel_id")


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in (0, 1, 1, 1, 2, 3, 4)], "v double, r2 double")
    edges = E.quantile_edges(df, "v", 4)
    assert edges == [0.0, 1.0, 2.5, 4.0]
    got = {r.bin: r.n for r in E.binned_summary(df, "v", bins=4).collect()}
    assert got == {0: 4, 1: 1, 2: 2}


def test_best_and_worst_and_series(spark):
    m = spark.createDataFrame([(0, 0.5), (1, None), (2, 0.9), (3, float("inf"))], "pixel_id long, r2 double")
    got = [(r.kind, r.pixel_id) for r in E.best_and_worst(m, k=1).collect()]
    assert got == [("best", 2), ("worst", 0)]
    assert E.pixel_series(m, m.where("pixel_id > 1")).count() == 2


def test_labels_and_maps(spark):
    p = spark.createDataFrame([(0, True), (1, False), (2, True)], "pixel_id long, base boolean")
    got = {r.pixel_id: r.r2 for r in E.metric_map(p, spark.createDataFrame([(2, 0.7)], "pixel_id long, r2 double"), "r2", "base").collect()}
    assert got == {0: 0.0, 1: None, 2: 0.7}


def test_forest_explanations_add_up(spark, table, tmp_path):
    rows = table.where("y IS NOT NULL").select("pixel_id", "a", "b", "y")
    for name, params in (("rf", {"numTrees": 4, "maxDepth": 4}), ("hgb", {"maxIter": 3, "maxDepth": 3})):
        fitted = model.train(rows, ["a", "b"], name, **params)
        forest = explain.leaves(fitted, f"file://{tmp_path}/{name}")
        out = explain.explain(model.predict(fitted, rows), ["a", "b"], forest).toPandas()
        np.testing.assert_allclose(out.shap_a + out.shap_b + explain.base_value(forest), out.y_pred, atol=1e-9)
    top = explain.importance(spark.createDataFrame(out), ["a", "b"]).orderBy(F.desc("mean_abs_shap")).first()
    assert top["feature"] == "a"


def test_models_by_name_and_saved(spark, table, tmp_path):
    with pytest.raises(ValueError):
        model.build_model("svm")
    rows = table.where("y IS NOT NULL")
    fitted = model.train(rows, ["a", "b"], "rf", "standard", numTrees=2, maxDepth=2)
    model.save_run(fitted, {"model": "rf"}, f"file://{tmp_path}/m")
    a, b = (model.predict(m, rows).agg(F.sum("y_pred")).first()[0] for m in (fitted, model.load_run(f"file://{tmp_path}/m")))
    assert a == pytest.approx(b)


def test_grid_check_of_a_grid_beyond_the_poles(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 240.0, -82.0), (2, 0, -60.0, -100.0)], "pixel_id long, time_idx int, latitude double, longitude double")
    SC.check_grid(cells, -60, 240, -100, -82)
    for bad, bounds in ((cells, ()), (cells, (-60, 239.5, -100, -82)), (cells, (-60, 240, -99, -82)), (cells.union(cells), (-60, 240, -100, -82))):
        with pytest.raises(ValueError):
            SC.check_grid(bad, *bounds)
    # suppliers enough for more than 300 rows of ten, which half a degree each takes past the pole
    data = "/root/testdata/sf0.001"
    for name in ("nation", "region", "lineitem"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{data}/supplier.parquet").crossJoin(spark.range(2).select("id")).withColumn("s_suppkey", F.col("s_suppkey") + F.col("id") * 5000).drop("id").write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalogue.QUERIES["grid_check"](spark, str(tmp_path)).first()
    assert got.lat_min == -60 and got.lon_max == -82 and got.n_cells > 0


def test_bins_of_aggregates_equal_but_for_rounding(spark):
    """Eight values ten times each, which differ in their last bits: a bin has all ten."""
    rng = random.Random(4)
    noisy = [(k + 1.1) * (1 + rng.choice([-1, 0, 1, 2]) * 2e-16) for k in range(8) for _ in range(10)]
    for n in (8, 4, 16):
        got = {r.bin: (r.n, round(r.mean_value, 6)) for r in E.binned_summary(spark.createDataFrame([(v, 1.0) for v in noisy], "v double, r2 double"), "v", bins=n).collect()}
        plain = {r.bin: (r.n, round(r.mean_value, 6)) for r in E.binned_summary(spark.createDataFrame([(round(v, 6), 1.0) for v in noisy], "v double, r2 double"), "v", bins=n).collect()}
        assert got == plain and all(k % 10 == 0 for k, _ in got.values()) and sum(k for k, _ in got.values()) == 80


def test_correlations_equal_to_six_digits_are_ties(spark):
    found = spark.createDataFrame([(1, "a", 0, 1 - 3e-16), (1, "b", 1, -1.0), (2, "a", 0, 0.5), (2, "b", 1, 0.50001)], "k int, predictor string, place int, r double")
    assert {r.k: (r.predictor, r.dominant_code) for r in X.strongest(found, ["k"]).collect()} == {1: ("a", 1), 2: ("b", 2)}


def test_lags_equal_to_six_digits_are_ties(spark, monkeypatch):
    found = spark.createDataFrame([("a", 0, 0.25), ("a", 1, 1 - 3e-16), ("a", 2, 1.0)], "predictor string, lag int, r double")
    monkeypatch.setattr(X, "lagged_correlations", lambda *_: found)
    assert X.best_lag(found, "y", ["a"], [0, 1, 2]).first().lag == 1


def test_rows_of_one_cell_are_explained_once(spark, tmp_path):
    """Rows between the same cuts of a forest share their values, also such as pass no test; only cells go to Python."""
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (300, 2))
    data = spark.createDataFrame([(float(a), float(b), float(2 * a - b)) for a, b in x], "a double, b double, y double")
    forest = explain.leaves(model.train(data, ["a", "b"], "rf", numTrees=4, maxDepth=4), f"file://{tmp_path}/forest")
    odd = [(None, 0.0), (float("nan"), 1.0), (float("-inf"), float("inf")), (0.5, 0.5), (0.5, 0.5), (1e300, -1e300)]
    asked = [(i, a, b, "old") for i, (a, b) in enumerate([*odd, *((float(a), float(b)) for a, b in x)])]
    cuts = sorted({float(c) for leaf in forest for f, lo, hi in zip(leaf.features, leaf.low, leaf.high, strict=True) if f == 0 for c in (lo, hi) if np.isfinite(c)})
    asked += [(len(asked) + i, c, c, "old") for i, c in enumerate(cuts)]
    rows = spark.createDataFrame(asked, "id int, a double, b double, shap_a string").repartition(3)
    out = explain.explain(rows, ["a", "b"], forest)
    assert out.columns == ["id", "a", "b", "shap_a", "shap_b"]
    assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[1]
    got = {r.id: (r.shap_a, r.shap_b) for r in out.collect()}
    want = explain.shapley(np.array([[np.nan if v is None else v for v in r[1:3]] for r in asked]), forest)
    assert len(got) == len(asked)
    np.testing.assert_allclose([got[r[0]] for r in asked], want, atol=1e-12)
    assert explain.explain(rows, ["a", "b"], []).where("shap_a = 0 AND shap_b = 0").count() == len(asked)


def test_a_cut_between_equal_keys_does_not_hang_on_the_order_of_rows(spark, tmp_path):
    rows = [(None, 1, 0.5), *((1, 2, v) for v in (4.0, None, 1.0, 3.0, 2.0)), (0, 9, 7.0)]
    for given in (rows, rows[::-1], sorted(rows[1:], key=lambda r: -(r[2] or 0)) + rows[:1]):
        model.write_csv(spark.createDataFrame(given, "a int, b int, v double").repartition(3), f"file://{tmp_path}/t", ["a", "b"], 4)
        assert [(r.a, r.v) for r in spark.read.csv(f"file://{tmp_path}/t", header=True, inferSchema=True).collect()] == [(0, 7.0), (1, 1.0), (1, 2.0), (1, 3.0)]
