"""Runs that are redone when their inputs change, annual variables, buckets and published folders."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import cube as C
from gridloom.operators import split as S
from gridloom.plans import workflow
from gridloom.plans.stages import Stages
from gridloom.sources import cube as SC
from gridloom.sources import fixtures
from gridloom.sources.config import resolve_data
from gridloom.sources.fingerprint import files_fingerprint, table_fingerprint


def long_cube(spark, n_pixels=6, years=range(2000, 2002), names=("LAI", "TP", "SM"), seed=2, gaps=9):
    rng = random.Random(seed)
    first = min(years)
    rows = [(v, (y - first) * 12 + m - 1, f"{y}-{m:02d}-01", p, float(y * 100 + m) + rng.random() if not gaps or (p + y + m) % gaps else None) for v in names for p in range(n_pixels) for y in years for m in range(1, 13)]
    return spark.createDataFrame(rows, "variable string, time_idx int, time string, pixel_id long, value double").withColumn("time", F.to_date("time"))


def grid(spark, n=6, missing=(5,)):
    return spark.createDataFrame([(i, i // 3, i % 3, i not in missing) for i in range(n)], "pixel_id long, lat_idx int, lon_idx int, kept boolean")


CONFIG = {"data": {"target": "LAI", "predictors": ["TP", "SM_LAG_1"]}, "train": {"test_fraction": 0.2, "params": {"numTrees": 2, "maxDepth": 2}}}


def test_fingerprints_tell_tables_apart(spark):
    rows = [(1, None, "a"), (None, 1, "a"), (1, None, "a"), (2, 3, None)]
    df = spark.createDataFrame(rows, "x int, y int, z string")
    same = table_fingerprint(df)
    assert same == table_fingerprint(df.repartition(3, "x").select("z", "y", "x"))
    others = [rows[:3], [*rows, rows[0]], [(1, None, "a"), (1, None, "a"), (1, None, "a"), (2, 3, None)], [*rows[:3], (3, 2, None)]]
    found = {table_fingerprint(spark.createDataFrame(r, "x int, y int, z string")) for r in others}
    assert len(found) == 4 and same not in found
    assert table_fingerprint(df.withColumnRenamed("x", "w")) != same
    assert table_fingerprint(df.limit(0)) != same


def test_a_run_redoes_what_hangs_on_a_change(spark, tmp_path):
    source, folder = f"file://{tmp_path}/cube", f"file://{tmp_path}/runs"
    SC.write_cube(long_cube(spark), source)
    go = lambda data=None, train=None, **how: workflow.run(spark, {"data": CONFIG["data"] | (data or {}), "train": CONFIG["train"] | (train or {})}, source, folder, how.get("pixels", grid(spark)), how.get("mask", grid(spark)))
    rest = ["split", "model", "evaluated"]
    first = go()
    assert first["redone"] == ["prepared LAI", "prepared TP", "prepared SM_LAG_1", "cube", *rest]
    assert go()["redone"] == []
    assert go(train={"params": {"numTrees": 3, "maxDepth": 2}})["redone"] == ["model", "evaluated"]
    assert go(train={"seed": 5})["redone"] == rest
    other = go(mask=grid(spark, missing=(4, 5)))
    assert other["redone"] == first["redone"]
    # the second mask's data, not the first's
    kept = spark.read.parquet(f"{other['table']}/table").select("pixel_id").distinct()
    assert {r[0] for r in kept.collect()} == {0, 1, 2, 3}
    assert go(pixels=grid(spark).withColumn("lon_idx", F.col("lon_idx") + 1))["redone"] == ["cube", *rest]
    assert go(data={"predictors": ["TP"]})["redone"] == ["cube", *rest]
    assert go(data={"start_year": 2001, "end_year": 2001})["redone"] == first["redone"]
    # what was made before is still there
    assert go()["redone"] == []
    SC.write_cube(long_cube(spark, names=("TP",), seed=3), f"{tmp_path}/other")
    spark.read.parquet(f"{tmp_path}/other").where("variable = 'TP'").drop("variable").write.mode("overwrite").parquet(f"{source}/variable=TP")
    assert go()["redone"] == ["prepared TP", "cube", *rest]


def test_a_second_period_has_its_own_model(spark, tmp_path):
    source, folder = f"file://{tmp_path}/cube", f"file://{tmp_path}/runs"
    SC.write_cube(long_cube(spark, years=range(1995, 1999), gaps=0), source)
    found = []
    for years in ((1995, 1996), (1997, 1998)):
        made = workflow.run(spark, {"data": CONFIG["data"] | {"start_year": years[0], "end_year": years[1]}, "train": CONFIG["train"]}, source, folder, grid(spark))
        p = spark.read.csv([f"{made['stages']['evaluated']}/predictions"], header=True, inferSchema=True).agg(F.min("y_pred"), F.max("y_pred")).first()
        found.append(p)
    assert found[0][0] >= years[0] * 100 - 300 and found[0][1] < 199700 and found[1][0] > 199700


def test_a_search_writes_its_results(spark, tmp_path):
    SC.write_cube(long_cube(spark, names=("LAI", "TP")), f"file://{tmp_path}/cube")
    search = {"space": {"numTrees": [1, 2], "maxDepth": [1, 2]}, "draws": 2, "folds": 2}
    made = workflow.run(spark, {"data": {"target": "LAI", "predictors": ["TP"]}, "train": {"test_fraction": 0.2, "search": search}}, f"file://{tmp_path}/cube", f"file://{tmp_path}/runs", grid(spark))
    rows = spark.read.csv(f"{made['model']}/cv_results", header=True, inferSchema=True).orderBy("rank").collect()
    assert 1 <= len(rows) <= 2 and [r.rmse_mean for r in rows] == sorted(r.rmse_mean for r in rows) and "maxDepth" in rows[0].params


def test_workflow_from_a_file(spark, tmp_path):
    SC.write_cube(long_cube(spark), f"file://{tmp_path}/cube")
    pixels = grid(spark)
    (tmp_path / "run.toml").write_text(
        '[data]\ntarget = "LAI"\npredictors = ["TP", "SM_LAG_1"]\nmasks = ["bs"]\nvalue_type = "anomaly"\ndetrend = true\n'
        '[train]\nsplit_mode = "spatial_pixel"\ntest_fraction = 0.2\n[train.params]\nnumTrees = 3\nmaxDepth = 3\n[explain]\nmax_total = 20\n'
    )
    pixels.select("pixel_id", (~F.col("kept")).alias("bs")).write.parquet(f"file://{tmp_path}/masks/bs")
    made = workflow.run(spark, str(tmp_path / "run.toml"), f"file://{tmp_path}/cube", f"file://{tmp_path}/runs", pixels, f"file://{tmp_path}/masks")
    info = made["dataset"]
    assert info["n_unique_train_pixels"] == 4 and info["n_unique_test_pixels"] == 1 and info["feature_names"] == ["TP", "SM_LAG_1"] and info["temporal_resolution_inferred"] == "monthly"
    assert {r["split"]: r["n"] for r in made["metrics"].collect()} == {"train": info["n_train"], "test": info["n_test"]}
    assert spark.read.csv(f"{made['stages']['explained']}/importance", header=True).count() == 2
    pixels.write.parquet(f"file://{tmp_path}/pixels")
    workflow.main([str(tmp_path / "run.toml"), f"file://{tmp_path}/cube", f"file://{tmp_path}/cli", f"file://{tmp_path}/pixels", "--masks", f"file://{tmp_path}/masks", "--seed", "7"])
    assert any("seed7" in p.name for p in (tmp_path / "cli").rglob("*") if p.is_dir())
    with pytest.raises(ValueError, match="no masks"):
        SC.combined_mask(spark, f"file://{tmp_path}/masks", ["bs", "nothing"])
    table = made["table"]
    SC.save_json(spark, info | {"n_test": 1}, f"{table}/dataset_metadata")
    with pytest.raises(ValueError, match="should have"):
        workflow.load_training(spark, table, "test")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gridloom")]


def test_annual_lags_come_after_the_years(spark, tmp_path):
    source = f"file://{tmp_path}/cube"
    cube = long_cube(spark, names=("LAI",), years=range(1995, 1999), gaps=0).unionByName(long_cube(spark, names=("TP",), years=range(1996, 1999), gaps=0)).unionByName(long_cube(spark, names=("SM",), years=range(1995, 1999), gaps=0))
    SC.write_cube(cube, source)
    data = resolve_data({"target": "LAI", "predictors": ["TP", "SM_LAG_1"], "resolution": "annual"})
    made = workflow.prepare(Stages(spark, f"file://{tmp_path}/runs"), data, source)
    value = {v: {(r.pixel_id, r.time_idx): r.value for r in SC.read_bucketed(spark, f"{s.path}/data").collect()} for v, s in made.items()}
    years = {(r.variable, r.pixel_id, r.year): r for r in cube.groupBy("variable", "pixel_id", F.year("time").alias("year")).agg(F.avg("value").alias("mean"), F.sum("value").alias("sum")).collect()}
    for (p, t), x in value["SM_LAG_1"].items():
        assert x is None if t == 0 else x == pytest.approx(years["SM", p, 1995 + t - 1]["mean"])
    # TP starts a year later, and its first year is the second of the run
    assert {t for _, t in value["TP"]} == {1, 2, 3} and value["TP"][0, 1] == pytest.approx(years["TP", 0, 1996]["sum"])
    wide = workflow.prepared_cube(spark, {v: s.path for v, s in made.items()}, grid(spark)).collect()
    assert all(abs(r.LAI - years["LAI", r.pixel_id, r.time.year]["mean"]) < 1e-6 and r.time.year == 1995 + r.time_idx for r in wide)
    plan = C.annual_series(SC.read_variable(spark, source, "SM"), "value", "mean", 1995, 1)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_years_of_one_step_keep_it(spark):
    rows = spark.createDataFrame([(1, "2000-01-01", 4.0), (1, "2001-01-01", None)], "pixel_id long, time string, v double").withColumn("time", F.to_date("time"))
    assert sorted((r.year, r.v) for r in C.annual(rows, {"v": "sum"}).collect()) == [(2000, 4.0), (2001, None)]
    mixed = rows.unionByName(rows.withColumn("time", F.add_months("time", 1)).limit(1))
    with pytest.raises(ValueError, match="incomplete"):
        C.annual(mixed, {"v": "sum"})


def test_bucketed_cubes_join_where_they_are(spark, tmp_path):
    cube = long_cube(spark)
    paths = {}
    for v in ("LAI", "TP", "SM"):
        paths[v] = f"file://{tmp_path}/{v}"
        C.preprocess(cube.where(F.col("variable") == v).drop("variable"), "value").save(paths[v], SC.KEYS)
    wide = workflow.prepared_cube(spark, paths, grid(spark))
    SC.write_bucketed(wide, f"file://{tmp_path}/cube", SC.KEYS)
    rows = SC.read_bucketed(spark, f"file://{tmp_path}/cube")
    SC.write_bucketed(S.observation_split(rows, ["LAI", "TP", "SM"], 0.5, 0.25), f"file://{tmp_path}/split", SC.KEYS)
    table = S.training_table(rows, "LAI", ["TP", "SM"], SC.read_bucketed(spark, f"file://{tmp_path}/split"))
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (wide.drop("lat_idx", "lon_idx"), table):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Join" in plan
            # only the pixels' places come to the cube
            assert plan.count("hashpartitioning(pixel_id") <= (2 if df is not table else 0), plan
        joined = workflow.reduce(lambda a, b: a.join(b.drop("time"), SC.KEYS), [SC.read_bucketed(spark, f"{p}/data").withColumnRenamed("value", v) for v, p in paths.items()])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert wide.count() == 6 * 24 and rows.count() == 6 * 24 and table.count() > 0
    assert files_fingerprint(spark, f"file://{tmp_path}/cube") != files_fingerprint(spark, f"file://{tmp_path}/split")


def test_lag_files_stay_when_new_ones_are_not_sound(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/lags"
    assert C.write_lags(long_cube(spark), path, [1, 2]).count() == 3 * 2 * 6 * 24
    whole = C.lags
    monkeypatch.setattr(C, "lags", lambda df, values, steps: whole(df, values, steps).where("NOT (variable = 'TP' AND time_idx = 3)"))
    with pytest.raises(ValueError, match="TP_LAG_1"):
        C.write_lags(long_cube(spark, seed=4), path, [1])
    back = spark.read.parquet(path)
    assert back.count() == 3 * 2 * 6 * 24 and {p.name for p in tmp_path.iterdir()} == {"lags"}
    monkeypatch.setattr(C, "lags", whole)
    assert C.write_lags(long_cube(spark), path, [3]).count() == 3 * 6 * 24


def test_no_shuffle_of_cells_that_is_not_needed(spark, tmp_path, monkeypatch):
    """Places are sent to the cells' buckets, which are kept; a split of all pixels needs no window; the steps of a
    fixture are read from its lines and not from cells made twice."""
    cells = spark.range(40).select((F.col("id") % 8).alias("pixel_id"), (F.col("id") / 8).cast("int").alias("time_idx"), F.make_date(F.lit(2000), F.lit(1), F.lit(1)).alias("time"), F.when(F.col("id") != 3, F.col("id") * 1.0).alias("value"))
    for v in ("A", "B"):
        SC.write_bucketed(cells, f"file://{tmp_path}/{v}/data", SC.KEYS)
    places = spark.range(8).select(F.col("id").alias("pixel_id"), F.lit(0).alias("lat_idx"), F.col("id").cast("int").alias("lon_idx")).repartition(2)
    made = {}
    for limit in (1_000_000, 0):
        monkeypatch.setattr(workflow, "BROADCAST_PIXELS", limit)
        out = workflow.prepared_cube(spark, {v: f"file://{tmp_path}/{v}" for v in ("A", "B")}, places)
        made[limit] = (sorted(map(tuple, out.collect()), key=str), out._jdf.queryExecution().optimizedPlan().toString())
    assert made[0][0] == made[1_000_000][0] and len(made[0][0]) == 40
    assert "strategy=broadcast" in made[1_000_000][1] and "strategy=broadcast" not in made[0][1]
    kept = S.valid_observations(cells, ["value"])
    assert kept.count() == 39 and "Window" not in kept._jdf.queryExecution().optimizedPlan().toString()
    plan = fixtures.cube(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [l_suppkey") == 1
