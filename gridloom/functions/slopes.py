"""Median slopes of series, in memory of their length.

Up to ``FEW`` points the slopes of all pairs are a bounded array. A longer series is answered by
counting: of points in order of x, as many slopes are at most s as pairs are inverted in the order
of y - s * x, so the slope of a rank is found by bisection over the doubles, each step in
n log n time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FEW = 512
_SIGN = 0x7FFFFFFFFFFFFFFF


def inversions(rank: np.ndarray) -> int:
    """Pairs of a permutation of 0 .. n - 1 that stand in falling order, bit by bit: among
    ranks of equal higher bits, a zero counts the ones before it."""
    total, r = 0, rank
    for level in range(max(int(len(r) - 1).bit_length(), 1) - 1, -1, -1):
        one = r >> level & 1
        before = np.cumsum(one) - one
        group = r >> (level + 1)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        base = np.repeat(before[first], np.diff(np.append(first, len(r))))
        total += int((before - base)[one == 0].sum())
        r = r[np.argsort(r >> level, kind="stable")]
    return total


def _at_most(x: np.ndarray, y: np.ndarray, slope: float, repeated: bool) -> int:
    """The slopes of pairs of different x that are ``slope`` at most; points are in order of x, then y."""
    z, place = y - slope * x, np.arange(len(x))
    order = np.lexsort((-place, z))
    rank = np.empty(len(x), np.int64)
    rank[order] = place
    n = inversions(rank)
    if repeated:  # pairs of equal x that look inverted are no pairs
        order = np.lexsort((z, x))
        same = np.append(False, (x[order][1:] == x[order][:-1]) & (z[order][1:] == z[order][:-1]))
        size = np.diff(np.append(np.flatnonzero(~same), len(x)))
        n -= int((size * (size - 1) // 2).sum())
    return n


def median_slope(x: np.ndarray, y: np.ndarray, few: int = FEW) -> float:
    """The median over all pairs of points of different x, 0 without one."""
    order = np.lexsort((y, x))
    x, y = x[order] - x.mean() if len(x) else x, y[order]
    if len(x) <= few:
        i, j = np.triu_indices(len(x), 1)
        dx = x[j] - x[i]
        slopes = ((y[j] - y[i])[dx > 0]) / dx[dx > 0]
        return float(np.median(slopes)) if len(slopes) else 0.0
    size = np.diff(np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)))
    n = len(x) * (len(x) - 1) // 2 - int((size * (size - 1) // 2).sum())
    if not n:
        return 0.0
    # the steepest pairs are of neighbouring x, and there of the outermost y
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    last = np.append(first[1:], len(x)) - 1
    step = x[first[1:]] - x[first[:-1]]
    lo, hi = float(((y[first[1:]] - y[last[:-1]]) / step).min()), float(((y[last[1:]] - y[first[:-1]]) / step).max())

    def key(v: float) -> int:
        i = int(np.float64(v).view(np.int64))
        return i if i >= 0 else i ^ _SIGN

    def value(k: int) -> float:
        return float(np.int64(k if k >= 0 else k ^ _SIGN).view(np.float64))

    def of_rank(r: int) -> float:
        a, b = key(lo), key(hi)
        while a < b:
            middle = (a + b) // 2
            if _at_most(x, y, value(middle), bool((size > 1).any())) >= r:
                b = middle
            else:
                a = middle + 1
        return value(a)

    low = of_rank((n + 1) // 2)
    return low if n % 2 else (low + of_rank(n // 2 + 1)) / 2


def median_slopes(series: DataFrame, few: int = FEW) -> DataFrame:
    """``pixel_id, slope`` from ``pixel_id, s``, an array of points ``x, y`` each; a pixel at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column("s")
            x, y = (np.asarray(points.flatten().field(k)) for k in range(2))
            ends = np.append(0, np.cumsum(points.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
            slopes = [median_slope(x[i:j], y[i:j], few) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("pixel_id"), pa.array(slopes, pa.float64())], ["pixel_id", "slope"])

    return series.select("pixel_id", "s").mapInArrow(run, f"pixel_id {series.schema['pixel_id'].dataType.simpleString()}, slope double")
