"""Column expressions with the missing-value rules of gridded data.

Missing is NULL. NaN is turned to NULL where data comes in (``null_if_nan``); infinities
stay, and statistics that need finite values test ``is_finite``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str
DAYS_PER_YEAR = 365.2425


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: ColumnOrName) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def is_finite(c: ColumnOrName) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def all_finite(*cs: ColumnOrName) -> Column:
    return reduce(lambda a, b: a & b, [is_finite(c) for c in cs])


def pair(a: ColumnOrName, b: ColumnOrName) -> tuple[Column, Column]:
    """Both where both are finite, else NULL."""
    ok = all_finite(a, b)
    return F.when(ok, col(a)), F.when(ok, col(b))


def safe_divide(a: ColumnOrName, b: ColumnOrName) -> Column:
    return col(a) / F.nullif(col(b), F.lit(0.0))


def safe_corr(a: ColumnOrName, b: ColumnOrName, min_n: int = 2) -> Column:
    """Pearson over finite pairs; NULL below ``min_n`` pairs or without variance."""
    x, y = pair(a, b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(x) >= min_n) & (spread > 0), F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


def skewness(c: ColumnOrName) -> Column:
    """Population skewness: NULL below 3 values, 0 without variance."""
    x = F.when(is_finite(c), col(c))
    return F.when(F.count(x) < 3, None).when(F.stddev_pop(x) == 0, 0.0).otherwise(F.skewness(x))


def kurtosis(c: ColumnOrName) -> Column:
    """Excess kurtosis: NULL below 4 values, 0 without variance."""
    x = F.when(is_finite(c), col(c))
    return F.when(F.count(x) < 4, None).when(F.stddev_pop(x) == 0, 0.0).otherwise(F.kurtosis(x))


def r2(y: ColumnOrName, p: ColumnOrName, min_n: int = 2, min_var: float = 0.0, perfect: bool = False) -> Column:
    """1 - residual over total squares. Without variance NULL, or with ``perfect`` 1 if
    all errors are 0 and else 0."""
    y, p = pair(y, p)
    squares, var = F.sum((y - p) * (y - p)), F.var_pop(y)
    usual = 1 - squares / F.nullif(var * F.count(y), F.lit(0.0))
    flat = F.when(squares == 0, 1.0).otherwise(0.0) if perfect else F.lit(None).cast("double")
    return F.when(F.count(y) < min_n, None).when(var <= min_var, flat).otherwise(usual)


def rmse(y: ColumnOrName, p: ColumnOrName) -> Column:
    y, p = pair(y, p)
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: ColumnOrName, p: ColumnOrName) -> Column:
    y, p = pair(y, p)
    return F.avg(F.abs(y - p))


def bias(y: ColumnOrName, p: ColumnOrName) -> Column:
    """Mean of prediction minus truth."""
    y, p = pair(y, p)
    return F.avg(p - y)


def fit_slope(y: ColumnOrName, p: ColumnOrName) -> Column:
    """Slope of the prediction regressed on the truth."""
    y, p = pair(y, p)
    return F.covar_pop(p, y) / F.nullif(F.var_pop(y), F.lit(0.0))


def fit_intercept(y: ColumnOrName, p: ColumnOrName) -> Column:
    a, b = pair(y, p)
    return F.avg(b) - fit_slope(y, p) * F.avg(a)


def bit_is_set(c: ColumnOrName, bit: int) -> Column:
    return F.shiftright(col(c), bit).bitwiseAND(1) == 1


def stable_order(seed: int, *ids: ColumnOrName) -> Column:
    """A random-looking order of rows that reruns and other engines repeat."""
    parts = [col(c).cast("string") for c in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
