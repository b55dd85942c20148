import datetime as dt
from statistics import mean, median

import pytest
from pyspark.sql import functions as F

from gridloom.operators import cube as C
from gridloom.plans import catalogue
from gridloom.sources import config, cube


def series(spark, values, pixel=0, start=(2000, 1)):
    rows = [(pixel, i, dt.date(start[0] + (start[1] - 1 + i) // 12, (start[1] - 1 + i) % 12 + 1, 1), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "pixel_id long, time_idx int, time date, v double")


def values(df, column="v"):
    return [r[column] for r in df.orderBy("pixel_id", "time_idx").collect()]


def test_names():
    assert cube.parse_variable("T2M_LAG_3") == ("T2M", 3)
    assert cube.parse_variable("SM1-2_LAG_1") == ("SM1-2_LAG_1", 0)
    with pytest.raises(ValueError):
        cube.parse_variable("T2M_LAG_0")
    assert cube.expand_names(["LC", "TP"], ["LC_B", "LC_A", "TP"]) == ["LC_A", "LC_B", "TP"]
    with pytest.raises(KeyError):
        cube.expand_names(["X"], ["Y"])


def test_roi_and_years(spark):
    with pytest.raises(ValueError):
        cube.Roi(5, 5, 0, 1)
    with pytest.raises(ValueError):
        cube.select_time(spark.range(1), 2001, None)
    grid = cube.Grid(-1.0, -1.0, 1.0, 3, 3, "2000-01-01", 14)
    p = grid.pixels(spark)
    assert cube.select_roi(p, {"lat_min": 0, "lat_max": 1, "lon_min": -1, "lon_max": 0}).count() == 4
    t = grid.times(spark)
    assert t.orderBy("time_idx").collect()[-1]["time"] == dt.date(2001, 2, 1)
    assert cube.time_resolution(t).first()[0] == "monthly"
    assert cube.time_resolution(t.where("time_idx % 12 = 0")).first()[0] == "annual"
    assert cube.time_resolution(t.where("time_idx <> 3")).first()[0] == "irregular"


def test_dense_cube_and_lag_over_a_gap(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0]).where("time_idx <> 1")
    assert values(C.shift(df, ["v"], 1)) == [None, None, 3.0]
    dense = cube.densify(df, spark.createDataFrame([(0,), (1,)], "pixel_id long"))
    assert dense.count() == 8 and dense.where("v IS NULL").count() == 5
    assert values(C.shift(dense.where("pixel_id = 0"), ["v"], 2)) == [None, None, 1.0, None]


def test_long_and_wide(spark):
    df = series(spark, [1.0, None]).withColumn("w", F.lit(5.0))
    long = cube.to_long(df, ["v", "w"], ["pixel_id", "time_idx"])
    back = cube.to_wide(long, ["v", "w"], ["pixel_id", "time_idx"])
    assert values(back) == [1.0, None] and values(back, "w") == [5.0, 5.0]


def test_annual(spark):
    df = series(spark, [1.0] * 12 + [None] * 12)
    total = C.annual(df, {"v": "sum"}).orderBy("year").collect()
    assert [(r.year, r.v, r.time) for r in total] == [(2000, 12.0, dt.date(2000, 1, 1)), (2001, 0.0, dt.date(2001, 1, 1))]
    assert [r.v for r in C.annual(df, {"v": "mean"}).orderBy("year").collect()] == [1.0, None]
    with pytest.raises(ValueError, match="2001"):
        C.annual(df.where("time_idx < 20"), {"v": "mean"})
    assert C.annual_rule("TP_LAG_1") == "sum" and C.annual_rule("T2M") == "mean"


def test_masks(spark):
    df = spark.createDataFrame([(0, 1, 1, 0), (1, 0, 1, 0), (2, 1, 3, 0), (3, 1, 1, 1), (4, None, 1, None)], "pixel_id long, land int, climate int, ebf int")
    parts = [C.MaskPart.named("land"), C.MaskPart.named("climate", (1, 2)), C.MaskPart.named("ebf")]
    masked = C.with_mask(df, parts)
    assert [r.pixel_id for r in masked.where("kept").collect()] == [0]
    assert tuple(C.mask_stats(masked).first()) == (1, 5, 0.2)
    applied = C.join_mask(series(spark, [1.0, 2.0]), masked, ["v"])
    assert values(applied) == [1.0, 2.0]
    assert values(C.join_mask(series(spark, [1.0], pixel=9), masked, ["v"])) == [None]
    assert C.misaligned(series(spark, [1.0], pixel=9), masked).count() == 6


def test_theil_sen_against_plain(spark):
    v = [1.0, 4.0, None, 2.0, 8.0, float("inf"), 5.0]
    df = series(spark, v).unionByName(series(spark, [None, 3.0], pixel=1)).unionByName(series(spark, [None], pixel=2))
    day = [dt.date(2000, 1 + i, 1).toordinal() / 365.2425 for i in range(7)]
    known = [(d, x) for d, x in zip(day, v) if x is not None and x != float("inf")]
    want = median((b[1] - a[1]) / (b[0] - a[0]) for i, a in enumerate(known) for b in known[i + 1 :])
    got = {r.pixel_id: r.slope for r in C.theil_sen(df, "v").collect()}
    assert got[0] == pytest.approx(want) and got[1] == 0.0 and got[2] == 0.0


@pytest.mark.parametrize("kind", ["real", "anomaly"])
@pytest.mark.parametrize("detrended", [False, True])
def test_preprocess_is_undone_exactly(spark, kind, detrended):
    v = [float((i * 7) % 11 + i) for i in range(30)]
    p = C.preprocess(series(spark, v), "v", "monthly", kind, detrended)
    assert values(C.reconstruct(p, "v")) == pytest.approx(v)
    if kind == "anomaly" and not detrended:
        assert values(p.data)[0] == pytest.approx(v[0] - mean(v[0::12]))


def test_coarsen_and_nearest(spark):
    grid = cube.Grid(0.0, 0.0, 1.0, 4, 4, "2000-01-01", 1).pixels(spark).withColumn("v", (F.col("lat_idx") < 2).cast("int"))
    got = {(r.lat_idx, r.lon_idx): (r["mean"], r.flag) for r in C.coarsen(grid, "v", 2, 0.5).collect()}
    assert got[(0, 0)] == (1.0, True) and got[(1, 1)] == (0.0, False)
    points = spark.createDataFrame([(-90.0, -180.0), (89.9, 179.9), (91.0, 0.0)], "latitude double, longitude double")
    assert [r.pixel_id for r in C.nearest_cells(points, 0.5, 360, 720).collect()] == [0, 360 * 720 - 1, None]


def test_scan_and_run_cache(spark, tmp_path):
    path = f"{tmp_path}/cube"
    df = series(spark, [float(i) for i in range(24)]).withColumns({"variable": F.lit("T2M"), "latitude": F.lit(0.0), "longitude": F.lit(0.0)}).withColumnRenamed("v", "value")
    cube.write_cube(df, path)
    got = cube.read_variable(spark, path, "T2M_LAG_2", start_year=2001, end_year=2001)
    assert [r.value for r in got.orderBy("time_idx").collect()] == [float(i) for i in range(10, 22)]
    conf = config.resolve_data({"target": " lai ", "predictors": ["tp", "TP", "LAI"], "masks": "Land"})
    assert (conf["target"], conf["predictors"], conf["masks"]) == ("LAI", ["TP"], ["land"])
    folder = f"{tmp_path}/run"
    assert not config.run_is_current(spark, conf, folder)
    config.mark_run(spark, conf, folder)
    assert config.run_is_current(spark, conf, folder) and not config.run_is_current(spark, conf | {"resolution": "annual"}, folder)
    assert config.fraction_tag(0.125) == "12p5" and config.fraction_tag(0.1) == "10"


def test_regrid_query_takes_all_pixels(spark, monkeypatch):
    rows = [(690, 69, 0), (709, 70, 9), (790, 79, 0), (800, 80, 0), (990, 99, 0)]
    monkeypatch.setattr(catalogue, "pixels", lambda *_: spark.createDataFrame(rows, "pixel_id long, lat_idx int, lon_idx int"))
    got = {r.point: (r.lat_idx, r.lon_idx) for r in catalogue.QUERIES["regrid_nearest"](spark, "").collect()}
    assert got == {690: (312, 2), 709: (317, 543), 790: (357, 2), 800: (None, None), 990: (None, None)}
