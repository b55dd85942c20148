"""A run from its configuration: prepare variables, join them, split, train, evaluate, explain.

Each is a stage of ``stages.Stages``: it is made once for each state of what it reads, which its
key says. A variable hangs on its own source files, the mask, box, years and preprocessing; the cube on
its variables and the pixels; the split on cube and fractions; the model on the training table and
its own options; metrics and explanation on the model.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import cube as C
from gridloom.operators import evaluate, explain, model, split
from gridloom.plans.stages import Stage, Stages
from gridloom.sources.config import load_toml, model_run_name, processed_run_name, resolve_data, resolve_train, split_name
from gridloom.sources.cube import KEYS, combined_mask, load_json, parse_variable, read_bucketed, read_variable, save_json, time_resolution, write_bucketed
from gridloom.sources.fingerprint import files_fingerprint, table_fingerprint

#: Some 50 MB in memory; a global grid of half a degree has 259,200.
BROADCAST_PIXELS = 1_000_000
DATA = ("roi", "start_year", "end_year", "resolution", "value_type", "detrend")


def first_year(spark: SparkSession, data: dict, source: str) -> int:
    """The year that annual steps are counted from, one for all variables of a run."""
    if data.get("start_year") is not None:
        return data["start_year"]
    return read_variable(spark, source, parse_variable(data["target"])[0]).agg(F.min(F.year("time"))).first()[0]


def prepare_variable(spark: SparkSession, data: dict, source: str, variable: str, folder: str, mask: DataFrame | None = None, origin: int | None = None) -> dict:
    """One variable: read, made annual if asked for, masked, preprocessed and saved; returns
    what was done to it. ``mask``: ``pixel_id, kept``; ``origin``: the year annual steps count from.
    Monthly lags are of months; annual ones of years, after the aggregation."""
    base, lag = parse_variable(variable)
    yearly = data["resolution"] == "annual"
    df = read_variable(spark, source, base if yearly else variable, data.get("roi"), data.get("start_year"), data.get("end_year"))
    rule = C.annual_rule(variable) if yearly else None
    if yearly:
        df = C.annual_series(df, "value", rule, first_year(spark, data, source) if origin is None else origin, lag)
    if mask is not None:
        df = C.join_mask(df, mask, ["value"])
    done = C.preprocess(df.select(*KEYS, "time", "value"), "value", data["resolution"], data["value_type"], bool(data.get("detrend")))
    done.save(folder, KEYS)
    said = {"variable": variable, "annual_rule": rule, "lag_steps": lag, "lag_unit": ("years" if yearly else "months") if lag else None, "masked": mask is not None, "steps": done.steps}
    save_json(spark, said, f"{folder}/summary")
    return said


def prepare(stages: Stages, data: dict, source: str, mask: DataFrame | None = None) -> dict[str, Stage]:
    """All variables of the run, each a stage."""
    spark = stages.spark
    options = {k: data.get(k) for k in DATA}
    if data["resolution"] == "annual":
        options["origin"] = first_year(spark, data, source)
    masked = table_fingerprint(mask.select("pixel_id", "kept")) if mask is not None else None
    out = {}
    for v in [data["target"], *data["predictors"]]:
        inputs = {"source": files_fingerprint(spark, source, parse_variable(v)[0]), "mask": masked}
        out[v] = stages.make(f"prepared {v}", options | {"variable": v}, inputs, lambda path, v=v: prepare_variable(spark, data, source, v, path, mask, options.get("origin")), f"prepared/{v}")
    return out


def prepared_cube(spark: SparkSession, variables: dict[str, str], pixels: DataFrame) -> DataFrame:
    """The prepared variables side by side, on the pixels' places. ``variables``: their folders. They
    are kept in buckets of their cells, so they are joined where they are, and places of up to
    ``BROADCAST_PIXELS`` are sent there."""
    tables = [read_bucketed(spark, f"{path}/data").select(*KEYS, *(["time"] if i == 0 else []), F.col("value").alias(v)) for i, (v, path) in enumerate(variables.items())]
    places = pixels.select("pixel_id", "lat_idx", "lon_idx")
    return reduce(lambda a, b: a.join(b, KEYS), tables).join(F.broadcast(places) if places.count() <= BROADCAST_PIXELS else places, "pixel_id")


def save_training(table: DataFrame, cube: DataFrame, target: str, predictors: list[str], split_table: DataFrame, train: dict, folder: str) -> dict:
    """Writes the training table by split, and its metadata; returns those."""
    table.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/table")
    spark = table.sparkSession
    of = {r["split"]: r for r in split.table_stats(spark.read.parquet(f"{folder}/table")).collect()}
    n = lambda s, c: of[s][c] if s in of else 0
    span = cube.agg(F.count_distinct("time_idx").alias("n_time"), F.min("time").alias("a"), F.max("time").alias("b"), F.count_distinct("lat_idx").alias("n_lat"), F.count_distinct("lon_idx").alias("n_lon")).first()
    info = {
        "split_mode": train["split_mode"], "n_train": n("train", "n"), "n_test": n("test", "n"), "n_unique_train_pixels": n("train", "n_pixels"), "n_unique_test_pixels": n("test", "n_pixels"),
        "n_features": len(predictors), "feature_names": list(predictors), "target": target, "n_time": span["n_time"], "time_start": str(span["a"]), "time_end": str(span["b"]),
        "temporal_resolution_inferred": time_resolution(cube).first()[0], "latitude_size": span["n_lat"], "longitude_size": span["n_lon"], "split_metadata": split.split_stats(split_table).first().asDict(),
    }
    save_json(spark, info, f"{folder}/dataset_metadata")
    return info


def load_training(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """The rows of one split, checked against the metadata."""
    info = load_json(spark, f"{folder}/dataset_metadata")
    table = spark.read.parquet(f"{folder}/table")
    if missing := [c for c in (*info["feature_names"], "y", "pixel_id", "time_idx") if c not in table.columns]:
        raise ValueError(f"{folder} lacks {missing}")
    rows = table.where(F.col("split") == part)
    if rows.count() != info[f"n_{part}"]:
        raise ValueError(f"{folder} should have {info[f'n_{part}']} rows for {part}")
    return rows


def build_cube(stages: Stages, variables: dict[str, Stage], pixels: DataFrame) -> Stage:
    places = pixels.select("pixel_id", "lat_idx", "lon_idx")
    inputs = variables | {"pixels": table_fingerprint(places)}
    return stages.make("cube", {"variables": list(variables)}, inputs, lambda path: write_bucketed(prepared_cube(stages.spark, {v: s.path for v, s in variables.items()}, places), path, KEYS))


def build_split(stages: Stages, data: dict, train: dict, cube: Stage) -> Stage:
    """The split's cells, in the cube's buckets, and the training table."""
    spark, names = stages.spark, [data["target"], *data["predictors"]]
    options = {k: train[k] for k in ("split_mode", "train_fraction", "test_fraction", "seed")} | {"target": data["target"], "predictors": data["predictors"]}

    def build(path: str) -> None:
        rows = read_bucketed(spark, cube.path)
        parts = split.SPLITS[train["split_mode"]](rows, names, train["train_fraction"], train["test_fraction"], train["seed"])
        write_bucketed(parts, f"{path}/split", [k for k in KEYS if k in parts.columns])
        parts = read_bucketed(spark, f"{path}/split")
        save_training(split.training_table(rows, data["target"], data["predictors"], parts), rows, data["target"], data["predictors"], parts, train, path)

    return stages.make("split", options, {"cube": cube}, build, split_name(train))


def train_final(stages: Stages, train: dict, table: Stage) -> Stage:
    """The model, trained with its ``params`` or, with ``search`` (``space``, ``draws``, ``folds``, ``metric``), the
    best of the draws; those are written as ``cv_results``, the best first."""
    options = {k: train.get(k) for k in ("model", "scaler", "seed", "params", "search")}

    def build(path: str) -> None:
        names = load_json(stages.spark, f"{table.path}/dataset_metadata")["feature_names"]
        rows = load_training(stages.spark, table.path, "train")
        if how := train.get("search"):
            dealt = split.folds(rows, how.get("folds", 5), train["seed"], group="pixel_id")
            metric = how.get("metric", "rmse")
            fitted, results = model.search(dealt, names, how["space"], how.get("draws", 25), train["model"], metric, train["seed"], train["scaler"])
            place = F.row_number().over(C.Window.orderBy(F.desc(f"{metric}_mean") if metric == "r2" else F.asc(f"{metric}_mean"), "draw"))
            model.write_csv(results.withColumn("rank", place), f"{path}/cv_results", ["rank"])  # a row a draw
        else:
            fitted = model.train(rows, names, train["model"], train["scaler"], train["seed"], **train.get("params", {}))
        model.save_run(fitted, options | {"table": table.key}, path)

    return stages.make("model", options, {"table": table}, build, model_run_name(train))


def evaluated(stages: Stages, table: Stage, trained: Stage) -> Stage:
    """``metrics`` by split and ``predictions`` of the test rows, as CSV."""

    def build(path: str) -> None:
        fitted = model.load_run(trained.path)
        parts = [model.predict(fitted, load_training(stages.spark, table.path, s)) for s in ("train", "test")]
        model.write_csv(parts[0].unionByName(parts[1]).groupBy("split").agg(*evaluate.metric_columns()), f"{path}/metrics", ["split"])
        model.write_csv(parts[1].select(*KEYS, "y_true", "y_pred"), f"{path}/predictions", KEYS)

    return stages.make("evaluated", {}, {"table": table, "model": trained}, build)


def explained(stages: Stages, table: Stage, trained: Stage, how: dict) -> Stage:
    def build(path: str) -> None:
        info = load_json(stages.spark, f"{table.path}/dataset_metadata")
        explain.run(load_training(stages.spark, table.path, "test"), model.load_run(trained.path), info["feature_names"], path, **how)

    return stages.make("explained", how, {"table": table, "model": trained}, build)


def run(spark: SparkSession, config: dict | str, source: str, folder: str, pixels: DataFrame, mask: DataFrame | str | None = None) -> dict:
    """All stages of a configuration, given as a dict or a TOML file with sections ``data``,
    ``train`` and, to have predictions explained, ``explain``. ``mask``: a table of ``pixel_id, kept``,
    or the folder that has the masks that ``data`` names. Returns the summary that it writes, and
    the metrics as a table by split."""
    config = load_toml(config) if isinstance(config, str) else config
    data, train = resolve_data(config["data"]), resolve_train(config.get("train", {}))
    if isinstance(mask, str):
        mask = combined_mask(spark, mask, data["masks"])
    stages = Stages(spark, f"{folder}/{processed_run_name(data)}")
    table = build_split(stages, data, train, build_cube(stages, prepare(stages, data, source, mask), pixels))
    trained = train_final(stages, train, table)
    result = evaluated(stages, table, trained)
    if (how := dict(config.get("explain") or {})).pop("enabled", bool(how)):
        how.setdefault("seed", train["seed"])
        explained(stages, table, trained, how)
    summary = {"table": table.path, "model": trained.path, "dataset": load_json(spark, f"{table.path}/dataset_metadata"), "stages": {s.name: s.path for s in stages.log}}
    save_json(spark, summary, f"{result.path}/summary")
    metrics = spark.read.csv(f"{result.path}/metrics", header=True, schema="split string, n long, rmse double, mae double, r2 double")
    return summary | {"redone": stages.redone, "metrics": metrics}


def main(argv: list[str] | None = None) -> None:
    """``python -m gridloom.plans.workflow run.toml SOURCE FOLDER PIXELS [--mask MASK | --masks FOLDER]
    [--seed N]``; a seed given here comes before those of the configuration."""
    args = argparse.ArgumentParser(description="Run a configuration.")
    for name in ("config", "source", "folder", "pixels"):
        args.add_argument(name)
    args.add_argument("--mask")
    args.add_argument("--masks")
    args.add_argument("--seed", type=int)
    a = args.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    config = load_toml(a.config)
    if a.seed is not None:
        for part in ("train", "explain"):
            if part in config or part == "train":
                config[part] = config.get(part, {}) | {"seed": a.seed}
    read = lambda path: spark.read.parquet(path) if path else None
    run(spark, config, a.source, a.folder, read(a.pixels), a.masks or read(a.mask))["metrics"].show()


if __name__ == "__main__":
    main()
