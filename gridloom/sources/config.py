"""Run configuration: TOML files, names derived from options, and the run cache."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from pyspark.sql import SparkSession

from gridloom.sources.cube import Roi, load_json, save_json

VALUE_TYPES = ("real", "anomaly")
SPLIT_MODES = ("spatial_pixel", "random_observation")
RESOLUTIONS = ("monthly", "annual")


def load_toml(path: str) -> dict:
    return tomllib.loads(Path(path).read_text())


def normalize_names(names: str | list[str] | None, upper: bool = True) -> list[str]:
    """A name or list of names, trimmed, in order, each once."""
    names = [names] if isinstance(names, str) else names or []
    out: list[str] = []
    for n in names:
        n = n.strip().upper() if upper else n.strip().lower()
        if n and n not in out:
            out.append(n)
    return out


def fraction_tag(fraction: float) -> str:
    """A fraction as percent in a name: 0.1 is 10, 0.125 is 12p5."""
    return f"{round(fraction * 100, 4):g}".replace(".", "p")


def resolve_data(config: dict) -> dict:
    """The data section, checked and completed."""
    c = dict(config)
    c["target"] = c.get("target", "LAI").strip().upper()
    c["predictors"] = [p for p in normalize_names(c.get("predictors")) if p != c["target"]]
    c["masks"] = normalize_names(c.get("masks"), upper=False)
    c["value_type"] = c.get("value_type", "real").strip().lower()
    c["resolution"] = c.get("resolution", "monthly").strip().lower()
    if c["value_type"] not in VALUE_TYPES or c["resolution"] not in RESOLUTIONS:
        raise ValueError(f"unknown value type or resolution: {c['value_type']}, {c['resolution']}")
    if c.get("roi"):
        c["roi"] = Roi.of(c["roi"])
    if (c.get("start_year") is None) != (c.get("end_year") is None):
        raise ValueError("give both years or neither")
    return c


def resolve_train(config: dict) -> dict:
    c = {"split_mode": "random_observation", "train_fraction": 1.0, "test_fraction": 0.1, "seed": 42, "model": "rf", "scaler": "none"} | config
    if c["split_mode"] not in SPLIT_MODES:
        raise ValueError(f"unknown split: {c['split_mode']}")
    if not (0 < c["train_fraction"] <= 1 and 0 < c["test_fraction"] < 1):
        raise ValueError("fractions must satisfy 0 < train <= 1 and 0 < test < 1")
    return c


def processed_run_name(data: dict) -> str:
    masks = "_".join(data["masks"]) or "nomask"
    return f"{masks}_{data['resolution']}_{data['value_type']}" + ("_detrended" if data.get("detrend") else "")


def split_name(train: dict) -> str:
    return f"{train['split_mode']}_train{fraction_tag(train['train_fraction'])}_test{fraction_tag(train['test_fraction'])}_seed{train['seed']}"


def model_run_name(train: dict) -> str:
    return f"{train['model']}_{train['scaler']}_{split_name(train)}"


def run_is_current(spark: SparkSession, config: dict, folder: str) -> bool:
    """Whether ``folder`` holds the finished result of this very configuration."""
    try:
        return load_json(spark, f"{folder}/run_config") == json.loads(json.dumps(_plain(config), default=str))
    except Exception as e:  # no such run; Spark names it in several classes
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return False
        raise


def mark_run(spark: SparkSession, config: dict, folder: str) -> None:
    """Written last, so that a run that was cut short is not taken for done."""
    save_json(spark, _plain(config), f"{folder}/run_config")


def _plain(config: object) -> object:
    if isinstance(config, dict):
        return {k: _plain(v) for k, v in config.items()}
    return vars(config) if isinstance(config, Roi) else config
