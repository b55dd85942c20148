import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import stats as S

INF, NAN = float("inf"), float("nan")


def one(spark, rows, *aggs):
    return spark.createDataFrame(rows, "x double, y double").agg(*aggs).first()


def test_null_if_nan_and_finite(spark):
    df = spark.createDataFrame([(1.0,), (None,), (NAN,), (INF,), (-INF,)], "x double")
    got = [tuple(r) for r in df.select(S.null_if_nan("x").isNull(), S.is_finite("x")).collect()]
    assert got == [(False, True), (True, False), (True, False), (False, False), (False, False)]


def test_corr_of_constant_short_and_odd_values(spark):
    assert one(spark, [(1.0, 1.0), (1.0, 2.0)], S.safe_corr("x", "y"))[0] is None
    assert one(spark, [(1.0, 1.0)], S.safe_corr("x", "y"))[0] is None
    assert one(spark, [], S.safe_corr("x", "y"))[0] is None
    rows = [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (NAN, 1.0), (INF, 1.0), (None, 1.0), (5.0, None)]
    assert one(spark, rows, S.safe_corr("x", "y"))[0] == pytest.approx(1.0)


def test_shape_statistics(spark):
    rows = [(v, None) for v in (1.0, 2.0, 4.0, 9.0)]
    skew, kurt = one(spark, rows, S.skewness("x"), S.kurtosis("x"))
    assert skew == pytest.approx(0.768421, abs=1e-5) and kurt == pytest.approx(-1.0, abs=0.01)
    assert tuple(one(spark, [(2.0, None)] * 5, S.skewness("x"), S.kurtosis("x"))) == (0.0, 0.0)
    assert tuple(one(spark, rows[:2], S.skewness("x"), S.kurtosis("x"))) == (None, None)


def test_r2_without_variance(spark):
    flat = [(1.0, 1.0), (1.0, 2.0)]
    assert one(spark, flat, S.r2("x", "y"))[0] is None
    assert one(spark, flat, S.r2("x", "y", perfect=True))[0] == 0.0
    assert one(spark, [(1.0, 1.0), (1.0, 1.0)], S.r2("x", "y", perfect=True))[0] == 1.0
    assert one(spark, [(1.0, 1.0)], S.r2("x", "y", perfect=True))[0] is None


def test_fit(spark):
    rows = [(float(x), 2.0 * x + 1) for x in range(5)]
    slope, intercept, bias, rmse, mae = one(spark, rows, S.fit_slope("x", "y"), S.fit_intercept("x", "y"), S.bias("x", "y"), S.rmse("x", "y"), S.mae("x", "y"))
    assert (slope, intercept, bias, mae) == pytest.approx((2.0, 1.0, 3.0, 3.0))
    assert rmse == pytest.approx(math.sqrt(sum((x + 1) ** 2 for x in range(5)) / 5))


def test_bits(spark):
    df = spark.range(8).select(S.bit_is_set(F.col("id"), 1))
    assert [r[0] for r in df.collect()] == [bool(i >> 1 & 1) for i in range(8)]
