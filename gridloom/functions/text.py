"""Names, and values read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.stats import ColumnOrName, col


def slug(c: ColumnOrName, default: str = "figure") -> Column:
    """Lower case, with one ``_`` for each run of other characters than letters and digits and
    none at the ends; ``default`` where nothing is left."""
    made = F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(made == "", default).otherwise(made)


def to_number(c: ColumnOrName) -> Column:
    """A double, NULL where the text is none."""
    return col(c).try_cast("double")


def to_day(c: ColumnOrName) -> Column:
    """A date, NULL where the text is none."""
    return col(c).try_cast("date")


def json_field(c: ColumnOrName, name: str, kind: str) -> Column:
    """A field of a JSON object, NULL where it has none of that kind."""
    return F.from_json(col(c), f"`{name}` {kind}")[name]


def json_object(*columns: ColumnOrName) -> Column:
    return F.to_json(F.struct(*[col(c) for c in columns]))
