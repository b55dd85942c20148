"""URL filters: rules by host and path, and trust propagated over the link graph.

A rule names a host and a path prefix; it fits its host and all subdomains, and the
longest fitting rule decides. What no rule fits is judged by its host: personalised
PageRank spreads trust from hosts that rules allow along links, and distrust from
hosts that rules block against them (who links to blocked hosts earns distrust); a
host with more distrust than trust, each relative to its even share, is blocked.

A rule table of at most ``MAX_COMPILED`` rows is compiled into the projection as a map
(its size is checked); a larger one is joined on host and prefix. Edges are counted per
pair of hosts before anything is joined. Both walks go in one set of rows, each step is one
job written to the shared folder, and they end when no step changes either by more than
``TOLERANCE`` in all (``STEPS`` at most, by when less than that is left); a host of very many
links is a key of a plain join of two shuffles, which Spark splits at run time.

Defined results for odd input: a null url or one without ``://`` has an empty host and
path, fits no rule and is allowed; null html has no links; html and urls of any length are
read whole; a host without links passes its trust back to the seeds; without seeds nothing
is trusted or distrusted and all is allowed; an empty table gives none; repeated pages are
judged each, and their links count each time; columns of the names that are added are
replaced, others kept. A rule that is null or has no verdict is left out, one without ``/``
fits all paths of its host, and of a rule with several verdicts block counts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, settle, settle_at

MAX_COMPILED = 64
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, TOLERANCE, STEPS = 0.85, 1e-6, 90


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    there = at > 0
    return (
        F.when(there, F.translate(host, UPPER, LOWER)).otherwise(F.lit("")),
        F.when(there, path).otherwise(F.lit("")),
    )


def _suffixes(host: Column) -> Column:
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """The rule strings that could fit, longest first, then the more specific host."""
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    both = F.flatten(
        F.transform(
            _suffixes(host),
            lambda s: F.transform(cuts, lambda n: F.struct((-(F.length(s) + n)).alias("order"), n.alias("n"), F.concat(s, F.substring(path, F.lit(1), n)).alias("rule"))),
        )
    )
    return F.transform(F.sort_array(both), lambda x: x["rule"])


def match_rules(pages: DataFrame, rules: Iterable[tuple[str, str]] | DataFrame) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` to ``pages`` with ``host`` and ``path``.

    ``rules``: pairs of ``host/path-prefix`` and verdict, or a table ``rule, verdict``.
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        table = rules.where("rule IS NOT NULL AND verdict IS NOT NULL").groupBy("rule").agg(F.max("verdict").alias("verdict"))
        head = table.limit(MAX_COMPILED + 1).collect()
        listed = [tuple(r) for r in head] if len(head) <= MAX_COMPILED else None
        # as many as there are lengths of path prefixes
        lengths = [r[0] for r in table.select(F.when(F.contains("rule", F.lit("/")), F.length("rule") - F.instr("rule", "/") + 1).otherwise(0).alias("n")).distinct().collect()]
    else:
        listed = sorted({r: v for r, v in sorted((r, v) for r, v in rules if r is not None and v is not None)}.items())
        lengths = sorted({len(r) - r.index("/") if "/" in r else 0 for r, _ in listed})
        if len(listed) > MAX_COMPILED:
            table, listed = spark.createDataFrame(listed, "rule string, verdict string"), None
    if listed is not None and not listed:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    fits = _candidates(F.col("host"), F.col("path"), lengths)
    if listed is not None:
        verdicts = F.create_map(*[F.lit(x) for r in listed for x in r])
        known = F.array(*[F.lit(r) for r, _ in listed])
        rule = F.get(F.filter(fits, lambda x: F.array_contains(known, x)), F.lit(0))
        return pages.withColumn("rule", rule).withColumn("rule_verdict", F.try_element_at(verdicts, F.col("rule")))
    # one row per distinct host and path and candidate, joined, and the best put back
    keys = pages.select("host", "path").distinct()
    tried = keys.select("host", "path", F.posexplode(_candidates(F.col("host"), F.col("path"), lengths)).alias("at", "rule"))
    best = tried.join(table, "rule").groupBy("host", "path").agg(F.min(F.struct("at", "rule", "verdict")).alias("b"))
    return pages.join(best, ["host", "path"], "left").withColumns({"rule": F.col("b.rule"), "rule_verdict": F.col("b.verdict")}).drop("b")


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """``src, dst, n``: links counted per pair of hosts; a relative link stays on its host."""
    links = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    absolute = F.regexp_extract(F.col("link"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    dst = F.when(absolute != "", F.translate(absolute, UPPER, LOWER)).otherwise(F.col("src"))
    per_page = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(links).alias("link"))
    return per_page.select("src", dst.alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def walks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, steps: int = STEPS) -> DataFrame:
    """Personalised PageRank: ``walk, host, score`` over ``walk, src, dst, n`` from
    ``walk, host, weight``, each walk for itself. It restarts at the seeds, also from hosts
    without links."""
    spark = edges.sparkSession
    # a sum per source is merged before the shuffle; a window would gather hosts whole
    out, at_out = settle_at(edges.groupBy("walk", "src").agg(F.sum("n").alias("all")))
    shares, at_shares = settle_at(edges.join(out, ["walk", "src"]).select("walk", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all") * damping).alias("share")))
    total = seeds.groupBy("walk").agg(F.sum("weight").alias("all")).where("all > 0")
    start, at_start = settle_at(seeds.join(F.broadcast(total), "walk").where("weight > 0").select("walk", "host", (F.col("weight") / F.col("all")).alias("p")))
    rank = start.select("walk", "host", F.col("p").alias("score"))
    zero, at_before = F.lit(0.0), at_out
    for _ in range(steps):
        moved = rank.join(shares, ["walk", "host"]).select("walk", F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("moved"), zero.alias("p"), zero.alias("was"))
        parts = moved.unionByName(start.select("walk", "host", zero.alias("moved"), "p", zero.alias("was"))).unionByName(rank.select("walk", "host", zero.alias("moved"), zero.alias("p"), F.col("score").alias("was")))
        now, at_now = settle_at(parts.groupBy("walk", "host").agg(*(F.sum(c).alias(c) for c in ("moved", "p", "was"))))
        # what did not move along a link goes back to the seeds: a number per walk
        back = {r["walk"]: 1.0 - r["moved"] for r in now.groupBy("walk").agg(F.sum("moved").alias("moved")).collect()}
        if not back:
            break
        share = F.lit(0.0)
        for walk, left in back.items():
            share = F.when(F.col("walk") == walk, left).otherwise(share)
        score = F.col("moved") + F.col("p") * share
        change = now.agg(F.sum(F.abs(score - F.col("was")))).first()[0]
        rank = now.select("walk", "host", score.alias("score"))
        discard(spark, at_before)  # no longer read
        at_before = at_now
        if change <= tolerance:
            break
    rank = settle(rank)
    for path in (at_shares, at_start, at_before):
        discard(spark, path)
    return rank


def host_verdicts(judged: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, trust, distrust, host_verdict`` for all hosts that a walk comes to."""
    spark = judged.sparkSession
    edges, at_edges = settle_at(edges)
    seeds, at_seeds = settle_at(
        judged.where(F.col("rule_verdict").isNotNull())
        .groupBy("host")
        .agg(F.count_if(F.col("rule_verdict") == "allow").alias("good"), F.count_if(F.col("rule_verdict") == "block").alias("bad"))
    )
    both = edges.select(F.lit("trust").alias("walk"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    begin = seeds.select(F.lit("trust").alias("walk"), "host", F.col("good").alias("weight")).unionByName(seeds.select(F.lit("distrust").alias("walk"), "host", F.col("bad").alias("weight")))
    rank = walks(both, begin, tolerance=tolerance)
    of = [F.sum(F.when(F.col("walk") == w, F.col("score")).otherwise(0.0)).alias(w) for w in ("trust", "distrust")]
    out = settle(rank.groupBy("host").agg(*of))
    for path in (at_edges, at_seeds):
        discard(spark, path)
    # what differs by no more than rounding is the same
    return out.withColumn("host_verdict", F.when(F.col("distrust") > F.col("trust") + 1e-9, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] | DataFrame = RULES, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``host, path, rule, trust, distrust, verdict`` to pages of ``url, html``;
    columns of these names are replaced."""
    host, path = host_and_path(F.col("url"))
    pages = pages.drop("rule", "rule_verdict", "trust", "distrust", "verdict", "host_verdict").withColumns({"host": host, "path": path})
    judged = match_rules(pages, rules)
    verdicts = host_verdicts(judged, host_edges(pages), tolerance)
    out = judged.join(verdicts, "host", "left").fillna(0.0, ["trust", "distrust"])
    return out.withColumn("verdict", F.coalesce("rule_verdict", "host_verdict", F.lit("allow"))).drop("rule_verdict", "host_verdict")
