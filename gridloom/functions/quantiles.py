"""Exact quantiles without gathering the values, in two scans.

The first scan counts each group and sketches it; a mergeable sketch says between which two values a
rank must fall, to within a share of the rows that it guarantees. The second counts what lies
below, at and between these values, and keeps what lies between the two of a rank. The
ranks asked for are read off there, so that a few numbers a group come to the driver. Groups and
columns, however many are asked for at once, share both scans.

What is kept for a rank is bounded by ``KEEP`` values: where the sketch leaves more between its two, as it
does beyond some 250 million rows a group, what is between is sketched again first.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.stats import is_finite

#: Ranks are off by a share of one in ``ACCURACY``; groups of up to ``FEW`` values are kept whole.
ACCURACY, FEW, KEEP = 10_000, 50_000, 100_000


@dataclass
class _Group:
    """``cuts``: values in order; ``keep``: of the ranges before, between and after them, which
    are kept; ``found``: the values at ranks; ``open_``: ranges with ranks still to be found, as lower
    cut, upper cut, rows before and rows in it."""

    n: int
    want: list[int]
    cuts: list[float] = field(default_factory=list)
    keep: list[bool] = field(default_factory=lambda: [True])
    found: dict[int, float] = field(default_factory=dict)
    open_: list[tuple[float, float, int, int]] = field(default_factory=list)

    def narrow(self, brackets: list[tuple[float, float, int]], keep: int) -> None:
        """``brackets``: two values and about how many rows are between them."""
        self.cuts = sorted({x for lo, hi, _ in brackets for x in (lo, hi)})
        spans = zip(self.cuts, self.cuts[1:], strict=False)
        self.keep = [False, *(any(a <= lo and hi <= b and n <= keep for a, b, n in brackets) for lo, hi in spans), False]


def _sketch(rows: DataFrame, fractions: list[float]) -> dict[tuple, tuple[int, list[float]]]:
    """Per group its size and about its values at the fractions."""
    made = rows.groupBy("m", "g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", fractions, ACCURACY).alias("s"))
    return {(r["m"], r["g"]): (r["n"], r["s"]) for r in made.collect()}


def _inside(rows: DataFrame, ranges: list[tuple[int, object, float, float]], fractions: list[float]) -> dict[tuple, list[float]]:
    """The same of what is between two values each."""
    kind = rows.schema["g"].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(ranges, f"cm int, cg {kind}, lo double, hi double")
    here = rows.join(F.broadcast(table), (F.col("m") == F.col("cm")) & F.col("g").eqNullSafe(F.col("cg")) & (F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi")))
    made = here.groupBy("m", "g", "lo").agg(F.percentile_approx("v", fractions, ACCURACY).alias("s"))
    return {(r["m"], r["g"], r["lo"]): r["s"] for r in made.collect()}


def _count(rows: DataFrame, groups: dict[tuple, _Group]) -> None:
    """Counts the rows by the cuts and reads off what ranks are at them or in what is kept."""
    from pyspark.sql import Window

    kind = rows.schema["g"].dataType.simpleString()
    table = [(m, g, x.cuts, x.keep, [r for r in x.want if r not in x.found]) for (m, g), x in groups.items()]
    cuts = rows.sparkSession.createDataFrame(table, f"cm int, cg {kind}, cuts array<double>, keep array<boolean>, want array<long>")
    dealt = rows.join(F.broadcast(cuts), (F.col("m") == F.col("cm")) & F.col("g").eqNullSafe(F.col("cg")))
    dealt = dealt.withColumn("k", F.size(F.filter("cuts", lambda c: c < F.col("v")))).withColumn("at", F.coalesce(F.get("cuts", F.col("k")) == F.col("v"), F.lit(False)))
    kept = F.when(~F.col("at") & F.get("keep", F.col("k")), F.col("v"))
    counted = dealt.groupBy("m", "g", "k", "at").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sort_array(F.collect_list(kept)).alias("values"), F.first("want").alias("want"))
    # what is between stands before the cut that ends it
    w = Window.partitionBy("m", "g").orderBy("k", "at").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    here = F.filter("want", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    # a range of equal values needs none kept
    value = lambda r: F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.get("values", (r - F.col("before")).cast("int")))
    read = counted.withColumn("found", F.transform(here, lambda r: F.struct(r.alias("rank"), value(r).alias("value"))))
    for x in groups.values():
        x.open_ = []
    for r in read.where(F.size("found") > 0).select("m", "g", "k", "n", "before", "found").collect():
        x = groups[r["m"], r["g"]]
        x.found |= {f["rank"]: f["value"] for f in r["found"] if f["value"] is not None}
        if any(f["value"] is None for f in r["found"]):
            lo, hi = (x.cuts[r["k"] - 1] if r["k"] else float("-inf")), (x.cuts[r["k"]] if r["k"] < len(x.cuts) else float("inf"))
            x.open_.append((lo, hi, r["before"], r["n"]))


def quantiles_of(df: DataFrame, values: list[str], probs: list[float], by: str | None = None, few: int = FEW, keep: int = KEEP) -> dict[str, dict[object, list[float]]]:
    """Of each column, per group of ``by`` (None: one group, named None), the values at ``probs``, between two
    ranks in proportion. Groups are few, as bins or variables are; one without finite values
    is not in the result."""
    group = F.col(by) if by else F.lit(None).cast("int")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)]))
    rows = df.select(group.alias("g"), each.alias("s")).select("g", "s.*").where(is_finite("v"))
    off = 2 / ACCURACY
    around = [min(max(f, 0.0), 1.0) for p in probs for f in (p - off, p + off)]
    groups: dict[tuple, _Group] = {}
    for key, (n, s) in _sketch(rows, around).items():
        x = groups[key] = _Group(n, sorted({r for p in probs for r in (floor(p * (n - 1)), ceil(p * (n - 1)))}))
        if n > few:
            x.narrow([(a, b, ceil(2 * off * n)) for a, b in zip(s[::2], s[1::2], strict=True)], keep)
    todo = groups
    while todo:
        _count(rows, todo)
        todo = {k: x for k, x in todo.items() if x.open_}
        if todo:
            steps = [i / 256 for i in range(257)]
            found = _inside(rows, [(*k, lo, hi) for k, x in todo.items() for lo, hi, _, _ in x.open_], steps)
            for k, x in todo.items():
                brackets = []
                for lo, _, before, n in x.open_:
                    s = found[(*k, lo)]
                    for r in (r for r in x.want if r not in x.found and before <= r < before + n):
                        at = (r - before) / max(n - 1, 1) * 256
                        i, j = max(floor(at) - 1, 0), min(ceil(at) + 1, 256)
                        brackets.append((s[i], s[j], ceil(n * (j - i + 1) / 256)))
                x.narrow(brackets, keep)

    def between(x: _Group, p: float) -> float:
        at = p * (x.n - 1)
        a, b = x.found[floor(at)], x.found[ceil(at)]
        return a if a == b else a * (ceil(at) - at) + b * (at - floor(at))

    out: dict[str, dict[object, list[float]]] = {v: {} for v in values}
    for (m, g), x in groups.items():
        out[values[m]][g] = [between(x, p) for p in probs]
    return out


def quantiles(df: DataFrame, value: str, probs: list[float], by: str | None = None, few: int = FEW, keep: int = KEEP) -> dict[object, list[float]]:
    """The same of one column."""
    return quantiles_of(df, [value], probs, by, few, keep)[value]


def quantile(df: DataFrame, value: str, prob: float) -> float | None:
    return quantiles(df, value, [prob]).get(None, [None])[0]
