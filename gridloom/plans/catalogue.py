"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as TX
from gridloom.functions.stats import bit_is_set
from gridloom.operators import cube as C
from gridloom.operators import evaluate as E
from gridloom.operators import explore as X
from gridloom.operators import model as M
from gridloom.operators import split as S
from gridloom.plans import learning
from gridloom.plans import workflow as W
from gridloom.plans.oracle import SQL
from gridloom.sources import cube as SC
from gridloom.sources import npy
from gridloom.plans.stages import Stages
from gridloom.sources.config import model_run_name, processed_run_name, resolve_data, resolve_train, split_name
from gridloom.sources.fixtures import PREDICTORS, VARIABLES, pixels, predictions, table
from gridloom.sources.fixtures import cube as fixture

T, LAGS = "target", [0, 1, 2, 3]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Doubles to six digits, so that engines that sum in another order agree."""
    d = digits or {}
    return df.select(*[F.round(c, d.get(c, 6)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def over_cube(name: str, keep: list[str] | None = None, **digits: int):
    """Registers a query that starts from the dense cube."""

    def register(f: Callable[[DataFrame], DataFrame]) -> None:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(fixture(spark, sf_dir))
            return rounded(out.select(*keep) if keep else out, digits)

        QUERIES[name] = query

    return register


def over_predictions(name: str, keep: list[str] | None = None, **digits: int):
    def register(f: Callable[[DataFrame], DataFrame]) -> None:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(predictions(spark, sf_dir))
            return rounded(out.select(*keep) if keep else out, digits)

        QUERIES[name] = query

    return register


def query(name: str):
    def register(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        return f

    return register


CELL = ["pixel_id", "time_idx", T]

over_cube("scan_time_roi", CELL)(lambda c: SC.select_time(c, 1996, 1998).where(F.col("lat_idx").between(0, 4) & F.col("lon_idx").between(2, 7)))
over_cube("dense_spine", ["pixel_id", "time_idx", "time", T])(lambda c: c)
over_cube("cube_long")(lambda c: SC.to_long(c, VARIABLES, ["pixel_id", "time_idx"]))
over_cube("grid_metadata")(SC.grid_metadata)
over_cube("time_resolution")(SC.time_resolution)
over_cube("masked_cube", CELL)(lambda c: C.apply_mask(C.with_mask(c, [C.MaskPart("keep"), C.MaskPart("code", (0, 1, 2))]), [T], "kept"))
over_cube("categorical_mask", CELL)(lambda c: C.apply_mask(c, [T], C.MaskPart("code", (1, 3)).keeps()))
over_cube("annual_mean", ["pixel_id", "year", "time", T])(lambda c: C.annual(SC.select_time(c, 1995, 2000), {T: C.annual_rule(T)}))
over_cube("annual_sum", ["pixel_id", "year", "time", "qty"])(lambda c: C.annual(C.full_years(c), {"qty": "sum"}, full_years=False))
over_cube("full_year_check")(C.year_lengths)
over_cube("climatology")(lambda c: C.climatology(c, [T]))
over_cube("climatology_annual")(lambda c: C.climatology(c, [T], "annual"))
over_cube("anomaly", CELL)(lambda c: C.anomaly(c, [T]))
over_cube("anomaly_spatial_mean")(lambda c: X.spatial_anomaly(c, T))
over_cube("monthly_climatology")(lambda c: X.monthly_climatology(c, T))
over_cube("lagged_values", ["pixel_id", "time_idx", "qty_LAG_1", "qty_LAG_2", "qty_LAG_3"])(lambda c: C.lags(c, ["qty"], [1, 2, 3]))
over_cube("time_years_centered")(C.centred_years)
over_cube("theil_sen_slope")(lambda c: C.theil_sen(c, T))
over_cube("detrended", CELL)(lambda c: C.preprocess(c, T, detrended=True).data)
over_cube("reconstructed", CELL)(lambda c: C.reconstruct(C.preprocess(c, T, value_type="anomaly", detrended=True), T))
over_cube("temporal_mean_map")(lambda c: X.temporal_map(c, T))
over_cube("spatial_mean_series")(lambda c: X.spatial_series(c, T))
over_cube("dataset_overview")(lambda c: X.overview(c, VARIABLES))
over_cube("structure_report")(lambda c: X.structure_report(c, VARIABLES))
over_cube("missing_summary")(lambda c: X.missing_summary(c, VARIABLES))
over_cube("univariate_stats")(lambda c: X.univariate(c, VARIABLES))
over_cube("global_corr_table")(lambda c: X.correlation_table(c, T, PREDICTORS))
over_cube("corr_matrix")(lambda c: X.correlation_matrix(c, VARIABLES))
over_cube("corr_matrix_lower")(lambda c: X.correlation_matrix(c, VARIABLES, "lower"))
over_cube("vif")(lambda c: X.vif(c, ["qty", "disc"]))
over_cube("pixel_corr", ["pixel_id", "predictor", "r"])(lambda c: X.correlations(c, T, PREDICTORS, ["pixel_id"]))
over_cube("pixel_lag_corr")(lambda c: X.lagged_correlations(c, T, PREDICTORS, LAGS, ["pixel_id"]))
over_cube("pixel_corr_sample")(lambda c: X.pivot(X.correlations(c.join(X.pixel_sample(c, T, 10), "pixel_id", "left_semi"), T, PREDICTORS, ["pixel_id"]), ["pixel_id"], "predictor", PREDICTORS))
over_cube("pixel_moments", ["pixel_id", "n", "sx", "sy"], sx=4)(lambda c: X.joint_moments(c, T, "qty"))
over_cube("spatial_corr_by_time", ["time_idx", "predictor", "r"])(lambda c: X.correlations(c, T, PREDICTORS, ["time_idx"]))
over_cube("spatial_corr_summary", mean=5, std=5)(lambda c: X.spatial_correlation_summary(c, T, PREDICTORS))
over_cube("spatial_corr_dominance")(lambda c: X.dominance(c, T, PREDICTORS))
over_cube("monthly_corr_table")(lambda c: X.pivot(X.correlations(c, T, PREDICTORS, [F.month("time").alias("month")]), ["predictor"], "month", list(range(1, 13))))
over_cube("lag_corr_table")(lambda c: X.pivot(X.lagged_correlations(c, T, PREDICTORS, LAGS).withColumn("lag", F.concat(F.lit("lag_"), "lag")), ["predictor"], "lag", [f"lag_{k}" for k in LAGS]))
over_cube("best_lag")(lambda c: X.best_lag(c, T, PREDICTORS, LAGS))
over_cube("category_corr", ["code", "label", "predictor", "r"])(lambda c: X.correlations(c, T, PREDICTORS, ["code", "label"]))
over_cube("category_corr_pivot")(lambda c: X.pivot(X.correlations(c, T, PREDICTORS, ["label"]), ["label"], "predictor", PREDICTORS))
over_cube("category_month_corr", ["label", "month", "predictor", "r"])(lambda c: X.correlations(c, T, PREDICTORS, ["label", F.month("time").alias("month")]))
over_cube("category_lag_corr")(lambda c: X.lagged_correlations(c, T, PREDICTORS, LAGS, ["label"]))
over_cube("dominant_predictor_map")(lambda c: X.dominant_map(c, T, PREDICTORS))
over_cube("dominant_by_category")(lambda c: X.dominant_by_category(c, T, PREDICTORS))
over_cube("valid_pixel_mask")(lambda c: S.valid_pixels(c, VARIABLES, 0.99))
over_cube("valid_obs_mask", ["pixel_id", "time_idx"])(lambda c: S.valid_observations(c, VARIABLES, 0.99))
over_cube("spatial_split")(lambda c: S.spatial_split(c, VARIABLES, 0.5, 0.25, min_fraction=0.9))
over_cube("observation_split")(lambda c: S.observation_split(c, VARIABLES, 0.5, 0.25))
over_cube("split_stats")(lambda c: S.split_stats(S.observation_split(c, VARIABLES, 0.5, 0.25)))
over_cube("train_test_export")(lambda c: S.training_table(c, T, PREDICTORS, S.observation_split(c, VARIABLES, 0.5, 0.25)))
over_cube("export_stats")(lambda c: S.table_stats(S.training_table(c, T, PREDICTORS, S.observation_split(c, VARIABLES, 0.5, 0.25))))
over_cube("land_mask")(lambda c: C.always_valid(c, T))
over_cube("scaled_standard", ["pixel_id", "time_idx", "qty"])(lambda c: M.standard_scaled(c, ["qty"]))
over_cube("scaled_robust", ["pixel_id", "time_idx", "qty"])(lambda c: M.robust_scaled(c, ["qty"]))

over_predictions("global_metrics")(E.global_metrics)
over_predictions("fit_metrics")(E.fit_metrics)
over_predictions("pixel_metrics", y_variance=4)(E.pixel_metrics)
over_predictions("pixel_metrics_spatial")(E.pixel_metrics_spatial)
over_predictions("pixel_metrics_summary", variance_mean=2)(lambda p: E.metrics_summary(E.pixel_metrics(p)))
over_predictions("best_worst_pixels", ["pixel_id", "r2", "kind"])(lambda p: E.best_and_worst(E.pixel_metrics(p), k=10))
over_predictions("pixel_series", ["order_id", "line", "pixel_id", "time", "y_true", "y_pred"])(lambda p: E.pixel_series(p, [1, 2, 3]))
over_predictions("prediction_errors", ["order_id", "line", "pixel_id", "residual", "abs_error"])(E.with_errors)
over_predictions("worst_error", ["order_id", "line", "abs_error"])(lambda p: E.worst_row(p, ["order_id", "line"]))
over_predictions("metrics_by_time")(E.metrics_by_time)
over_predictions("obs_metrics_by_time")(E.observation_metrics_by_time)
over_predictions("pixel_obs_summary")(E.pixel_observations)
over_predictions("binned_r2", mean_value=4)(lambda p: E.binned_summary(E.pixel_metrics(p), "y_variance"))
over_predictions("error_bins")(E.error_bins)
over_predictions("residual_bins")(E.residual_bins)
over_predictions("ape_hist")(E.ape_histogram)
over_predictions("metric_hist")(lambda p: E.histogram(E.pixel_metrics(p), "rmse"))
over_predictions("density2d")(lambda p: E.density(p, "y_true", "y_pred", 5000, 5000))


@query("lag_name_parse")
def _(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select("n_name", F.concat_ws("_LAG_", "n_name", "n_regionkey").alias("name"))
    return SC.parse_variables(names).select(F.col("n_name").alias("name"), "base", "lag").distinct()


@query("combined_mask_stats")
def _(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumn("ebf", F.col("lon_idx") % 2)
    return C.mask_stats(C.with_mask(p, [C.MaskPart("keep"), C.MaskPart("code", (0, 1, 2)), C.MaskPart.named("ebf")]))


@query("category_summary")
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("label"))
    return X.category_summary(fixture(spark, sf_dir), labels, T)


@query("dominant_category_map")
def _(spark, sf_dir):
    return X.paint(pixels(spark, sf_dir), X.dominant_by_category(fixture(spark, sf_dir), T, PREDICTORS))


@query("split_overlap")
def _(spark, sf_dir):
    s = S.spatial_split(fixture(spark, sf_dir), VARIABLES, 0.5, 0.25, min_fraction=0.9)
    return S.overlap(s.where("split = 'train'"), s.where("split = 'test'"), ["pixel_id"])


@query("group_folds")
def _(spark, sf_dir):
    return S.folds(pixels(spark, sf_dir).select("pixel_id"), 5, group="pixel_id")


@query("stratified_sample")
def _(spark, sf_dir):
    return S.stratified_sample(pixels(spark, sf_dir).select("pixel_id", "code"), "code", ["pixel_id"], 8, 0.5, 20)


@query("head_sample")
def _(spark, sf_dir):
    return S.head_sample(pixels(spark, sf_dir).select("pixel_id", "code"), ["pixel_id"], 10)


@query("category_metrics")
def _(spark, sf_dir):
    return E.category_metrics(predictions(spark, sf_dir).join(pixels(spark, sf_dir).select("pixel_id", "code", "label"), "pixel_id"))


@query("mask_label_lookup")
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("label"))
    return E.label_codes(predictions(spark, sf_dir), pixels(spark, sf_dir), labels).select("order_id", "line", "label")


@query("metric_map")
def _(spark, sf_dir):
    return E.metric_map(pixels(spark, sf_dir), E.pixel_metrics(predictions(spark, sf_dir)), "r2", "keep")


@query("coarsen_mask")
def _(spark, sf_dir):
    return C.coarsen(pixels(spark, sf_dir).withColumn("keep", F.col("keep").cast("int")), "keep", 5, 0.5)


@query("bit_flags")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", bit_is_set("p_size", 1).alias("bit1"), bit_is_set("p_size", 2).alias("bit2"))


@query("class_masks_coverage")
def _(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("n_pixels"))


@query("regrid_nearest")
def _(spark, sf_dir):
    p = pixels(spark, sf_dir)
    points = p.select(F.col("pixel_id").alias("point"), (F.col("lat_idx") * 2.25 - 89).alias("latitude"), (F.col("lon_idx") * 30.1 - 179).alias("longitude"))
    return C.nearest_cells(points, 0.5, 360, 720).select("point", "lat_idx", "lon_idx")


@query("preview_stride")
def _(spark, sf_dir):
    return C.stride(pixels(spark, sf_dir), 3).select("pixel_id")


def _long(spark: SparkSession, sf_dir: str, names: dict[str, str]) -> DataFrame:
    """The fixture as a long cube whose variables are named anew."""
    c = fixture(spark, sf_dir).select("pixel_id", "time_idx", "time", *(F.col(v).alias(n) for v, n in names.items()))
    return SC.to_long(c, list(names.values()), ["pixel_id", "time_idx", "time"])


def _kept(spark: SparkSession, sf_dir: str, names: dict[str, str]) -> str:
    path = learning.scratch(spark)
    SC.write_cube(_long(spark, sf_dir, names), path)
    return path


def _place(p: DataFrame) -> DataFrame:
    return p.withColumns({"latitude": F.col("lat_idx") * 0.5 - 60, "longitude": F.col("lon_idx") * 2.0 - 100})


@query("select_roi")
def _(spark, sf_dir):
    return SC.select_roi(_place(pixels(spark, sf_dir)), {"lat_min": -60, "lat_max": -40, "lon_min": -97, "lon_max": -90}).select("pixel_id", "latitude", "longitude")


@query("standard_axes")
def _(spark, sf_dir):
    return SC.standard_axes(_place(pixels(spark, sf_dir)).select("pixel_id", F.col("latitude").alias("lat"), F.col("longitude").alias("X")))


@query("axis_index")
def _(spark, sf_dir):
    return SC.axis_index(_place(pixels(spark, sf_dir)).select("pixel_id", (-F.col("latitude")).alias("latitude")), "latitude", "place").select("pixel_id", "place")


@query("flip_axis")
def _(spark, sf_dir):
    return SC.flip_rows(pixels(spark, sf_dir), 1_000_000).select("pixel_id", "lat_idx", "lon_idx")


@query("coordinate_lookup")
def _(spark, sf_dir):
    c = fixture(spark, sf_dir)
    return SC.with_coordinates(c.select("pixel_id", "time_idx"), _place(pixels(spark, sf_dir)), c.select("time_idx", "time").distinct())


@query("scan_variable")
def _(spark, sf_dir):
    path = _kept(spark, sf_dir, {"target": "LAI", "qty": "TP"})
    return SC.read_variable(spark, path, "lai", start_year=1996, end_year=1998).select("variable", "pixel_id", "time_idx", "value")


@query("scan_lagged_variable")
def _(spark, sf_dir):
    path = _kept(spark, sf_dir, {"target": "LAI", "qty": "TP"})
    return SC.read_variable(spark, path, "TP_LAG_2", start_year=1996, end_year=1998).select("variable", "pixel_id", "time_idx", "value")


@query("scan_expanded_names")
def _(spark, sf_dir):
    path = _kept(spark, sf_dir, {"target": "LAI", "qty": "TP_A", "disc": "TP_B", "tax": "SM"})
    return SC.read_cube(spark, path, ["LAI", "TP"]).select("variable", "pixel_id", "time_idx", "value")


@query("class_variables")
def _(spark, sf_dir):
    c = fixture(spark, sf_dir).select("pixel_id", "time_idx", F.col("code").alias("class"), F.col("target").alias("value"))
    return SC.stack_classes(c, "lai")


@query("lagged_files")
def _(spark, sf_dir):
    out = C.write_lags(_long(spark, sf_dir, {"qty": "TP", "disc": "SM"}), learning.scratch(spark), [1, 2])
    return out.select("variable", "pixel_id", "time_idx", "value")


@query("reconstructed_from_files")
def _(spark, sf_dir):
    path = learning.scratch(spark)
    C.preprocess(fixture(spark, sf_dir).select("pixel_id", "time_idx", "time", T), T, value_type="anomaly", detrended=True).save(path)
    return C.reconstruct(C.Preprocessed.load(spark, path), T).select(*CELL)


@query("mask_labels")
def _(spark, sf_dir):
    path = learning.scratch(spark)
    table(spark, sf_dir, "region").select(F.lit("region").alias("mask"), F.col("r_regionkey").alias("code"), F.col("r_name").alias("label")).write.parquet(path)
    return SC.labels_of(spark, path, "region")


@query("available_masks")
def _(spark, sf_dir):
    path = learning.scratch(spark)
    pixels(spark, sf_dir).select("pixel_id", "code").write.parquet(f"{path}/climate")
    found = SC.available_masks(spark, path, ["climate", "landcover"])
    return reduce(DataFrame.unionByName, [df.withColumn("mask", F.lit(n)) for n, df in found.items()])


@query("scan_files_by_name")
def _(spark, sf_dir):
    return SC.read_files(spark, sf_dir, "nation*.parquet")


@query("coerced_casts")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("given", F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.concat(F.col("n_nationkey"), F.lit(".5"))))
    dates = F.concat(F.lit("2001-0"), F.col("n_nationkey") % 10, F.lit("-10"))
    return n.select("n_nationkey", TX.to_number("given").alias("number"), TX.to_day(dates).alias("day"))


@query("slug_names")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", TX.slug("p_type").alias("slug"))


@query("classification_metrics")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return M.fit_report(lines.select((F.col("l_linenumber") % 3).alias("y_true"), (F.col("l_partkey") % 7 % 4).cast("double").alias("y_pred")))


@query("csv_sample")
def _(spark, sf_dir):
    path = learning.scratch(spark)
    M.write_csv(predictions(spark, sf_dir).select("order_id", "line", "y_true"), path, ["order_id", "line"], 500)
    return spark.read.csv(path, header=True, schema="order_id long, line int, y_true double")


@query("selected_pixel_series")
def _(spark, sf_dir):
    p = predictions(spark, sf_dir)
    chosen = E.best_and_worst(E.pixel_metrics(p), k=2).select("pixel_id", "kind")
    return p.join(chosen, "pixel_id").select("kind", "pixel_id", "order_id", "line", "y_true", "y_pred")


@query("category_spatial_metrics")
def _(spark, sf_dir):
    return E.category_spatial_metrics(predictions(spark, sf_dir).join(pixels(spark, sf_dir).select("pixel_id", "code", "label"), "pixel_id"))


@query("spatial_bundle")
def _(spark, sf_dir):
    found = E.spatial_bundle(predictions(spark, sf_dir), pixels(spark, sf_dir), "keep")
    return reduce(DataFrame.unionByName, [found[f"stats_{m}"].withColumn("metric", F.lit(m)) for m in ("r2", "rmse", "mae")])


@query("spatial_bundle_frames")
def _(spark, sf_dir):
    return _frames(E.spatial_bundle(predictions(spark, sf_dir), pixels(spark, sf_dir), "keep"))


@query("observation_bundle_frames")
def _(spark, sf_dir):
    return _frames(E.observation_bundle(predictions(spark, sf_dir)))


def _frames(found: dict[str, DataFrame]) -> DataFrame:
    """Of every table of a bundle the rows, and over its columns of counts and numbers (all but places
    and bins) the sums."""
    parts = []
    for name, df in found.items():
        numbers = [c for c, t in df.dtypes if t in ("double", "bigint", "int") and c not in ("pixel_id", "lat_idx", "lon_idx", "bin", "hx", "hy")]
        total = reduce(lambda a, b: a + b, [F.coalesce(F.sum(F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))), F.lit(0.0)) for c in numbers])
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), F.bround(F.log(F.abs(total) + 1), 6).alias("log_sum")).withColumn("frame", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@query("observation_bundle")
def _(spark, sf_dir):
    return E.observation_bundle(predictions(spark, sf_dir))["stats_residual"]


@query("workflow_metadata")
def _(spark, sf_dir):
    source = _kept(spark, sf_dir, {"target": "LAI", "qty": "TP", "disc": "SM", "tax": "TAX"})
    config = {
        "data": {"target": "LAI", "predictors": ["TP", "SM", "TAX"], "value_type": "anomaly"},
        "train": {"train_fraction": 0.5, "test_fraction": 0.25, "params": {"numTrees": 3, "maxDepth": 3}},
        "explain": {"max_total": 200},
    }
    info = W.run(spark, config, source, learning.scratch(spark), pixels(spark, sf_dir))["dataset"]
    names = ["n_train", "n_test", "n_unique_train_pixels", "n_unique_test_pixels", "n_features", "n_time"]
    row = [*(int(info[n]) for n in names), info["time_start"], info["time_end"], info["temporal_resolution_inferred"]]
    return spark.createDataFrame([row], ", ".join([*(f"{n} long" for n in names), "time_start string", "time_end string", "resolution string"]))


@query("training_scan")
def _(spark, sf_dir):
    c, path = fixture(spark, sf_dir), learning.scratch(spark)
    parts = S.observation_split(c, VARIABLES, 0.5, 0.25)
    W.save_training(S.training_table(c, T, PREDICTORS, parts), c, T, PREDICTORS, parts, {"split_mode": "random_observation"}, path)
    return W.load_training(spark, path, "train").select("pixel_id", "time_idx", *PREDICTORS, "y")


@query("grid_pixels")
def _(spark, sf_dir):
    last = pixels(spark, sf_dir).agg(F.max("pixel_id")).first()[0] or 0
    grid = SC.Grid(-89.75, -179.75, 0.5, last // 72 + 1, 72, "1982-01-01", 1)  # as many rows as the pixels need
    return grid.pixels(spark).join(pixels(spark, sf_dir).select(F.col("pixel_id").cast("int").alias("pixel_id")), "pixel_id")


@query("grid_times")
def _(spark, sf_dir):
    months = SC.Grid(0, 0, 1, 1, 1, "1995-01-01", 83).times(spark)
    return fixture(spark, sf_dir).select("time_idx").distinct().join(months, "time_idx")


@query("grid_check")
def _(spark, sf_dir):
    c = _place(fixture(spark, sf_dir)).select("pixel_id", "time_idx", "latitude", "longitude")
    low, high = (pixels(spark, sf_dir).agg(f("lat_idx")).first()[0] or 0 for f in (F.min, F.max))
    SC.check_grid(c, low * 0.5 - 60, high * 0.5 - 60, -100, 9 * 2.0 - 100)  # as many rows as the pixels need
    return c.agg(F.count(F.lit(1)).alias("n_cells"), F.min("latitude").alias("lat_min"), F.max("longitude").alias("lon_max"))


@query("cube_shape")
def _(spark, sf_dir):
    c = fixture(spark, sf_dir)
    n_time = c.select("time_idx").distinct().count()
    SC.check_shape(c, pixels(spark, sf_dir).count(), n_time)
    return c.agg(F.count_distinct("pixel_id").alias("n_pixels"), F.count_distinct("time_idx").alias("n_time"), F.count(F.lit(1)).alias("n_cells"))


@query("mask_misaligned")
def _(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return C.misaligned(p.where("code < 3"), p.where("code > 1"))


@query("category_pixels")
def _(spark, sf_dir):
    return S.category_sample(pixels(spark, sf_dir), "code", ["pixel_id"], 5).select("code", "pixel_id")


@query("metadata_files")
def _(spark, sf_dir):
    """What is known of each variable, written and read back in both forms of the file."""
    counts = fixture(spark, sf_dir).agg(*[F.count(v).alias(v) for v in VARIABLES]).first()
    entries = {v: {"path": f"{v}.parquet", "n": counts[v]} for v in VARIABLES}
    rows = []
    for form, value in (("nested", {"title": "cube", "variables": entries}), ("flat", {"title": "cube", "grid": {"rows": 1}, **entries})):
        path = learning.scratch(spark)
        SC.save_json(spark, value, path)
        rows += [(form, name, e["path"], e["n"]) for name, e in SC.variables_of(SC.load_json(spark, path)).items()]
    return spark.createDataFrame(rows, "form string, variable string, path string, n long")


@query("row_folds")
def _(spark, sf_dir):
    return S.folds(fixture(spark, sf_dir).select("pixel_id", "time_idx"), 4)


@query("json_fields")
def _(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_id", TX.json_field("props", "k", "long").alias("k"))
    return parsed.withColumn("again", TX.json_object("k"))


@query("saved_model_predictions")
def _(spark, sf_dir):
    rows, path = learning.rows(spark, sf_dir), learning.scratch(spark)
    fitted = M.train(rows.where("split = 'train'"), PREDICTORS, "rf", "standard", numTrees=2, maxDepth=3)
    M.save_run(fitted, {"model": "rf"}, path)
    a, b = (M.predict(m, rows).select("pixel_id", "time_idx", F.col("y_pred").alias(n)) for m, n in ((fitted, "a"), (M.load_run(path), "b")))
    return a.join(b, ["pixel_id", "time_idx"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("n_different"))


@query("annual_lagged")
def _(spark, sf_dir):
    path = _kept(spark, sf_dir, {"target": "LAI", "qty": "TP"})
    years = SC.read_variable(spark, path, "TP", start_year=1995, end_year=2000)
    return C.annual_series(years, "value", C.annual_rule("TP_LAG_2"), 1995, 2).select("pixel_id", "time_idx", "time", "value")


@query("annual_aligned")
def _(spark, sf_dir):
    path = learning.scratch(spark)
    SC.write_cube(_long(spark, sf_dir, {"target": "LAI", "qty": "TP", "disc": "SM"}).where("variable <> 'TP' OR year(time) >= 1996"), path)
    data = resolve_data({"target": "LAI", "predictors": ["TP", "SM_LAG_1"], "resolution": "annual", "start_year": 1995, "end_year": 2000})
    made = W.prepare(Stages(spark, learning.scratch(spark)), data, path)
    return W.prepared_cube(spark, {v: s.path for v, s in made.items()}, pixels(spark, sf_dir)).select("pixel_id", "time_idx", "time", "LAI", "TP", (F.col("SM_LAG_1") * 1000).alias("SM_LAG_1"))


@query("run_cache")
def _(spark, sf_dir):
    """Which stages are redone when one input has changed, and how many rows the table then has."""
    path, folder, p = learning.scratch(spark), learning.scratch(spark), pixels(spark, sf_dir)
    SC.write_cube(_long(spark, sf_dir, {"target": "LAI", "qty": "TP", "disc": "SM"}), path)
    train = resolve_train({"test_fraction": 0.25})
    kept = C.with_mask(p, [C.MaskPart("keep")])

    def go(name: str, mask: DataFrame = kept, places: DataFrame = p, predictors: tuple[str, ...] = ("TP", "SM"), **years) -> tuple[str, str, int]:
        data, stages = resolve_data({"target": "LAI", "predictors": list(predictors), **years}), Stages(spark, folder)
        made = W.build_split(stages, data, train, W.build_cube(stages, W.prepare(stages, data, path, mask), places))
        info = SC.load_json(spark, f"{made.path}/dataset_metadata")
        return name, ",".join(stages.redone), info["n_train"] + info["n_test"]

    rows = [go("first"), go("same"), go("mask", C.with_mask(p, [C.MaskPart("code", (0, 1, 2))])), go("pixels", places=p.withColumn("lon_idx", F.col("lon_idx") + 1)), go("years", start_year=1996, end_year=1998), go("predictors", predictors=("TP",))]
    fewer = _long(spark, sf_dir, {"disc": "SM"}).where("time_idx % 2 = 0").drop("variable")
    fewer.write.mode("overwrite").parquet(f"{path}/variable=SM")
    return spark.createDataFrame([*rows, go("source")], "scenario string, redone string, n_rows long")


@query("config_names")
def _(spark, sf_dir):
    def names(k: int, n: str) -> tuple[int, str, str, str, str]:
        data = resolve_data({"target": f" {n.lower()}", "predictors": ["tp", n, "TP"], "masks": "Climate" if k % 2 else [], "value_type": "Anomaly" if k % 3 == 0 else "real", "detrend": k % 5 == 0})
        train = resolve_train({"train_fraction": (k + 1) / 32})
        return k, ",".join(data["predictors"]), processed_run_name(data), split_name(train), model_run_name(train)

    known = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # a configuration each
    return spark.createDataFrame([names(*r) for r in known], "n_nationkey long, predictors string, processed string, split string, model string")


@query("resampled_nearest")
def _(spark, sf_dir):
    grid = SC.Grid(-85.0, -175.0, 10.0, 18, 36, "1982-01-01", 1).pixels(spark)
    at = lambda c, m, n: (F.col(c) * m) % n
    points = table(spark, sf_dir, "customer").select((at("c_custkey", 37, 1801) / 10 - 90).alias("latitude"), (at("c_custkey", 101, 3607) / 10 - 180).alias("longitude"), F.col("c_acctbal").alias("v"))
    return C.resample_nearest(points, "v", grid, 10.0, 0.0).select("lat_idx", "lon_idx", "v")


@query("array_scan")
def _(spark, sf_dir):
    c, path = fixture(spark, sf_dir), learning.scratch(spark)
    n_lat, n_lon = (r + 1 for r in pixels(spark, sf_dir).agg(F.max("lat_idx"), F.max("lon_idx")).first())
    npy.write_npy(c, "qty", path, n_lat, n_lon, dtype="float64")
    return npy.read_npy(spark, path, n_lat, n_lon).where("time_idx BETWEEN 12 AND 35 AND value IS NOT NULL").select("time_idx", "lat_idx", "lon_idx", "value")


over_predictions("density_hex")(lambda p: E.density_hex(p, "y_true", "y_pred", 30))
over_predictions("target_year", ["order_id", "line", "pixel_id"])(lambda p: E.target_year(p, 1997))
over_predictions("value_stats")(lambda p: E.value_stats(E.pixel_metrics(p), "rmse"))

QUERIES |= learning.QUERIES
ORACLE_SQL: dict[str, str] = dict(SQL)
