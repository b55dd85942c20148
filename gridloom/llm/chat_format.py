"""Chat formatting of reply trees.

Messages form trees: each names its parent. ``branches`` finds, by self-joins that
double their reach, every message's root, depth and summed score; leaves are ranked
by mean score within their tree; ``paths`` walks from each chosen leaf to its root in
as many joins as the depth has binary digits; ``format_paths`` writes each path as one
conversation with its loss mask, and ``read_back`` parses it again. All of it is
DataFrame expressions: no user function runs.

The template marks turns with control strings. Where such a string, or an escaped one,
stands in a text, one backslash is put after its ``<``; reading takes one away.

Defined results for odd input: null texts and roles are empty; a message whose parent
is missing is a root; messages on a cycle have no root and are left out; repeated
messages are turns of their own, in order of role and text; equal scores rank by the
leaf's id; texts of any length are taken whole; a conversation of numbered turns is put in
order in one task, and each chosen path is one row, so either must fit there; an empty table
gives none; columns beside those named are not kept, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import settle

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def threads(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations of numbered turns as trees: each turn replies to the one before."""
    order = Window.partitionBy(conv).orderBy(F.asc_nulls_first(turn), "role", "text")
    numbered = messages.select(
        F.col(conv).alias("tree"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.row_number().over(order).cast("long").alias("node"),
    )
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))


def _same(a: str, b: str, node_a: str, node_b: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.{node_a}") == F.col(f"{b}.{node_b}"))


def jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables ``tree, node, up, score, n``: after k steps, ``up`` is the ancestor 2**k
    above, and ``score`` sums the ``n`` messages passed. A message whose way ends goes to
    the second result, with the sums up to its root, and is jumped from no more."""
    known = nodes.select("tree", "node", "parent", "score")
    have = known.select("tree", F.col("node").alias("up"))
    linked = known.alias("a").join(have.alias("b"), _same("a", "b", "parent", "up"), "left")
    now = settle(linked.select("a.tree", "a.node", F.col("b.up").alias("up"), "a.score", F.lit(1).cast("long").alias("n")))
    ended, live = now.where("up IS NULL"), now.where("up IS NOT NULL")
    out, most = [], now.count()
    while 2 ** len(out) <= 2 * most and not live.isEmpty():
        out.append(live)
        go = live.alias("a").join(ended.unionByName(live).alias("b"), _same("a", "b", "up", "node"))
        sums = [(F.col(f"a.{c}") + F.col(f"b.{c}")).alias(c) for c in ("score", "n")]
        now = settle(go.select("a.tree", "a.node", F.col("b.up").alias("up"), *sums))
        ended, live = ended.unionByName(now.where("up IS NULL")), now.where("up IS NOT NULL")
    return out, ended


def best_leaves(nodes: DataFrame, ended: DataFrame, top: int) -> DataFrame:
    """``tree, leaf, rank``: of each tree the ``top`` leaves of the best mean score.
    Messages on a cycle have no root and so never end."""
    parents = nodes.where("parent IS NOT NULL").select("tree", F.col("parent").alias("up")).distinct()
    leaves = ended.alias("a").join(parents.alias("b"), _same("a", "b", "node", "up"), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("n"), "leaf")
    ranked = leaves.select("tree", F.col("node").alias("leaf"), (F.col("score") / F.col("n")).alias("mean"), "n")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("tree", "leaf", "rank")


def paths(leaves: DataFrame, table: list[DataFrame]) -> DataFrame:
    """``tree, leaf, rank, node, up_by``: all messages from each leaf to its root."""
    seen = leaves.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up_by"))
    for k, jump in enumerate(table):
        far = seen.alias("a").join(jump.alias("b"), _same("a", "b", "node", "node"))
        more = far.select("a.tree", "a.leaf", "a.rank", F.col("b.up").alias("node"), (F.col("a.up_by") + 2**k).alias("up_by"))
        seen = settle(seen.unionByName(more))
    return seen


def format_paths(found: DataFrame, nodes: DataFrame, learn: str = "assistant") -> DataFrame:
    """``tree, leaf, rank, formatted, loss``; ``loss`` lists start and length, in code
    points of ``formatted``, of each text that is learned."""
    n = nodes.select("tree", "node", "role", "text")
    rows = found.alias("a").join(n.alias("b"), _same("a", "b", "node", "node")).select("a.tree", "a.leaf", "a.rank", "a.up_by", "b.role", "b.text")
    head = F.concat(F.lit(START), F.regexp_replace(F.regexp_replace(escape(F.col("role")), "%", "%25"), "\n", "%0A"), F.lit("\n"))
    body = escape(F.col("text"))
    turn = F.struct((-F.col("up_by")).alias("at"), head.alias("head"), body.alias("body"), (F.col("role") == learn).alias("learn"))
    turns = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    tail = f"{END}\n"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        start, length = a["at"] + F.length(t["head"]), F.length(t["body"])
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct((start + length + len(tail)).alias("at"), F.when(t["learn"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return turns.select(
        "tree", "leaf", "rank",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("formatted"),
        F.aggregate("turns", zero, step, lambda a: a["spans"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``learned`` (texts), parsed from ``formatted``."""

    def turn(part: Column) -> Column:
        at = F.instr(part, "\n")
        role = unescape(F.regexp_replace(F.regexp_replace(F.substring(part, F.lit(1), at - 1), "%0A", "\n"), "%25", "%"))
        text = F.substring(part, at + 1, F.length(part) - at - len(END) - 1)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    parts = F.slice(F.split("formatted", F.lit(r"<\|im_start\|>")), 2, 2**30)
    return formatted.withColumns(
        {
            "turns": F.transform(parts, turn),
            "learned": F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))),
        }
    )


def format_trees(nodes: DataFrame, top: int = 1) -> DataFrame:
    """One conversation per tree and chosen leaf."""
    table, ended = jumps(nodes)
    return format_paths(paths(best_leaves(nodes, ended, top), table), nodes)
