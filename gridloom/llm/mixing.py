"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words (``source_targets``). A document's expected
copies are its source's target spread over the source by document weight; their
whole part is certain, and for the rest the documents of a source are ranked by
their random odds divided by their inclusion odds, ``(u/(1-u)) / (p/(1-p))``, and
taken in that order until the source's words are reached. ``u`` is a hash of the
seed and the document's id (without one, its text), so reruns agree.

The cut of a source is found on histograms of the rank, twice refined, so that only
the documents of one bin in a million are ever put in order; no source, however hot,
is sorted or collected whole. The answer is one small row per source, and taking it
to the documents is a join that leaves their texts where they are.

Defined results for odd input: a null text has size 0 and is taken 0 words; a null
source is a source of its own, the last; rows that repeat an id rank the same and are
taken or left together, and a row without an id goes by its text; a source of size 0 has
target 0; a text of any length is one document; an empty table gives none; columns of the
names that are added are replaced, others kept. The sources, a row each, are put in order in
one task, the documents nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, settle, text_or_empty

CYCLE = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2.0
SEED = "mix-1"
BITS, STEP = 40, 10


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, cycle=CYCLE, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Sources in code point order, null last, weigh ``cycle`` over and over and share
    ``share`` of all words; none gets more than ``cap`` times its size, the excess is
    shared anew. That fixed point is found in one pass over the sources in order of
    size by weight: those below the common level are full, the others stand at it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int"))
    w = per.withColumn("w", weight).withColumns({"top": F.col("source_size") * F.lit(cap), "budget": F.sum("source_size").over(every) * F.lit(share)})
    w = w.withColumn("full_at", F.col("top") / F.col("w"))
    before = Window.orderBy("full_at", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns(
        {
            "level": (F.col("budget") - F.coalesce(F.sum("top").over(before), F.lit(0.0)))
            / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
            "place": F.row_number().over(Window.orderBy("full_at", F.asc_nulls_last("source"))),
        }
    )
    # the first source in order that does not fill; what stands after it is not its level
    common = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("place", "level"))).over(every)["level"]
    w = w.withColumn("common", common)
    target = F.when(F.col("common").isNull(), F.col("top")).otherwise(F.least(F.col("top"), F.col("common") * F.col("w")))
    return w.select("source", "source_size", target.alias("target"))


def expected_copies(docs: DataFrame, targets: DataFrame, weight: str | None, cap: float) -> DataFrame:
    """``targets`` with ``rate``: a document's expected copies are ``rate`` times its
    weight, ``cap`` at most. With weights, the excess of capped documents is shared
    anew within the source until none is above."""
    if weight is None:
        return targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    out, capped = targets.withColumn("rate", F.lit(0.0)), None
    for _ in range(50):
        e = F.col("rate") * F.col(weight)
        part = with_sources(docs, out).groupBy("source").agg(
            F.sum(F.when(e >= cap, F.col("size") * cap).otherwise(0.0)).alias("full"),
            F.sum(F.when(e >= cap, 0.0).otherwise(F.col("size") * F.col(weight))).alias("open"),
            F.sum(F.when(e >= cap, 1).otherwise(0)).alias("n"),
        )
        out = settle(
            with_sources(targets, part).withColumn("rate", F.when(F.col("open") > 0, (F.col("target") - F.col("full")) / F.col("open")).otherwise(F.lit(cap)))
        ).select("source", "source_size", "target", "rate", "n")
        now = out.agg(F.sum("n")).first()[0]
        out = out.drop("n")
        if now == capped:
            break
        capped = now
    return out


def with_sources(docs: DataFrame, per_source: DataFrame) -> DataFrame:
    other = per_source.withColumnRenamed("source", "__source")
    return docs.join(other, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def rank(docs: DataFrame, weight: str | None, cap: float, seed: str) -> DataFrame:
    """Adds ``whole`` copies, and the rank of the rest as ``(__k, __h)``; __k is null
    where nothing is left to draw."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("__of")))
    e = F.least(F.col("rate") * (F.col(weight) if weight else F.lit(1.0)), F.lit(cap))
    u = (F.conv(F.substring("__h", 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    q = (F.col("__u") / (1 - F.col("__u"))) / (F.col("__p") / (1 - F.col("__p")))
    return (
        docs.withColumns({"__h": h, "__e": e})
        .withColumns({"whole": F.floor("__e"), "__u": u})
        .withColumn("__p", F.col("__e") - F.col("whole"))
        .withColumn("__q", F.when((F.col("__p") > 0) & (F.col("size") > 0), q))
        .withColumn("__k", F.floor(F.col("__q") / (1 + F.col("__q")) * float(2**BITS)))
        .drop("__e", "__u", "__p", "__q")
    )


def cuts(docs: DataFrame, weight: str | None = None, cycle=CYCLE, share: float = SHARE, cap: float = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """One row per source: ``source, source_size, target, rate, cut_k, cut_h``. What
    ranks up to the cut is taken once more than its whole copies."""
    per = settle(expected_copies(docs, source_targets(docs, cycle, share, cap), weight, cap))
    ranked = rank(with_sources(docs, per), weight, cap, seed)
    left = ranked.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("sure"))
    state = left.select("source", (F.col("target") - F.col("sure")).alias("want"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("bin"))
    state, shift = settle(state), BITS
    pool = ranked.where(F.col("__k").isNotNull()).select("source", "size", "__k", "__h")
    while shift > BITS - 2 * STEP:
        inside = with_sources(pool, state).where(F.shiftright("__k", shift) == F.col("bin"))
        bins = inside.withColumn("b", F.shiftright("__k", shift - STEP)).groupBy("source", "b").agg(F.sum("size").alias("n"), F.first("base").alias("base"), F.first("want").alias("want"))
        run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("base", F.col("base") + F.coalesce(F.sum("n").over(run), F.lit(0)))
        # the last bin that starts below what is wanted
        state = settle(bins.where(F.col("base") < F.col("want")).groupBy("source").agg(F.max(F.struct("b", "base", "want")).alias("s")).select("source", "s.want", "s.base", F.col("s.b").alias("bin")))
        shift -= STEP
    edge = with_sources(pool, state).where(F.shiftright("__k", shift) == F.col("bin"))
    edge = edge.groupBy("source", "__k", "__h").agg(F.sum("size").alias("n"), F.first("base").alias("base"), F.first("want").alias("want"))
    run = Window.partitionBy("source").orderBy("__k", "__h").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("base") + F.coalesce(F.sum("n").over(run), F.lit(0)) + F.col("n") / 2.0
    last = edge.withColumn("middle", middle).where(F.col("middle") <= F.col("want")).groupBy("source").agg(F.max(F.struct("__k", "__h")).alias("s"))
    # without such a document the cut stands before the whole bin
    found = with_sources(state.select("source", F.shiftleft("bin", shift).alias("first")), last)
    found = found.select("source", F.coalesce("s.__k", F.col("first") - 1).alias("cut_k"), F.coalesce("s.__h", F.lit("g")).alias("cut_h"))
    return with_sources(per, found)


def mix(docs: DataFrame, text: str = "text", weight: str | None = None, cycle=CYCLE, share: float = SHARE, cap: float = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """``docs`` with ``size, source_size, target`` and ``copies``, the number of times
    that the mix takes the document. Columns of these names are replaced."""
    of = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(text_or_empty(text))))
    sized = docs.drop("size").withColumns({"size": n_words(text), "__of": of})
    small = settle(sized.select("__of", "source", "size", *([weight] if weight else [])))
    per = settle(cuts(small, weight, cycle, share, cap, seed))
    out = rank(with_sources(sized.drop("source_size", "target", "rate", "copies", "whole", "cut_k", "cut_h"), per), weight, cap, seed)
    extra = (F.col("__k") < F.col("cut_k")) | ((F.col("__k") == F.col("cut_k")) & (F.col("__h") <= F.col("cut_h")))
    copies = F.col("whole") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)
    return out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long")).drop("__k", "__h", "__of", "whole", "rate", "cut_k", "cut_h")
