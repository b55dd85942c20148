"""Stages of a run that are made once for each state of their inputs.

A stage's key is a digest of its name, its own options and the keys or fingerprints of what it
reads, and its folder is named by the key. So a stage is redone when, and only when, something it
hangs on has changed, what was made for other inputs stays beside it, and a run that was cut
short leaves no mark and is made again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from gridloom.sources.config import mark_run, run_is_current
from gridloom.sources.fingerprint import digest

#: Changes where what a stage writes does, so that older results are not taken for it.
FORMAT = 2


@dataclass(frozen=True)
class Stage:
    name: str
    key: str
    path: str
    made: bool


@dataclass
class Stages:
    """All stages below ``folder``; ``log`` has those of this run in order."""

    spark: SparkSession
    folder: str
    log: list[Stage] = field(default_factory=list)

    def make(self, name: str, options: dict, inputs: dict[str, Stage | str | None], build: Callable[[str], object], at: str | None = None) -> Stage:
        """The stage of that name: ``build(path)`` writes it where it is not there yet."""
        known = {k: v.key if isinstance(v, Stage) else v for k, v in inputs.items()}
        config = {"stage": name, "format": FORMAT, "options": options, "inputs": known}
        key = digest(config)
        path = f"{self.folder}/{at or name}/{key[:16]}"
        new = not run_is_current(self.spark, config | {"key": key}, path)
        if new:
            build(path)
            mark_run(self.spark, config | {"key": key}, path)
        self.log.append(Stage(name, key, path, new))
        return self.log[-1]

    @property
    def redone(self) -> list[str]:
        return [s.name for s in self.log if s.made]
