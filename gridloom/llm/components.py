"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, settle, settle_at


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, label`` of all nodes of ``a, b``: the least node of each component. More than
    ``rounds`` rounds, which grow with the logarithm of a component's length, raise.

    Large-star and small-star steps in turn link each node's neighbours to the least of
    them, until only stars are left. The least is merged before the shuffle, written, and
    taken back by a join of two shuffles, which Spark splits where a node has very many
    edges. Each step is written to the shared folder, and what it read is deleted.
    """
    spark = edges.sparkSession
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now, at_now = settle_at(edges.where("a <> b").select(hi.alias("hi"), lo.alias("lo")).distinct())
    state = None
    for _ in range(rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least, at_least = settle_at(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large, at_large = settle_at(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        discard(spark, at_now)
        discard(spark, at_least)
        least, at_least = settle_at(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        now, at_now = settle_at(small.select("e.*").where("hi <> lo").distinct())
        discard(spark, at_large)
        discard(spark, at_least)
        new = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(hi, lo))")).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components are not found after {rounds} rounds")
    roots = now.select(F.col("lo").alias("node")).distinct()
    out = settle(now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(roots.select("node", F.col("node").alias("label"))))
    discard(spark, at_now)
    return out
