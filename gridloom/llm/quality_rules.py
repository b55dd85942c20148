"""Quality rules: a threshold table compiled into one Spark projection.

Each rule names a metric, the side on which a document fails and a threshold;
``apply_rules`` turns the table into boolean columns of one projection over the
documents. There is no user function and no shuffle: everything is built-in
expressions over the row's own text.

Defined results for odd input: a null text counts as empty (no words, all counts
0, it fails the base rules); a text of any length is judged whole, by its row's task; ties and repeated rows are judged each on its own; an
empty table gives an empty table; extra input columns are kept by ``apply_rules``
unless their name is one of the columns it adds, which then wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ASCII_SPACE, text_or_empty

#: Common words of the four languages of the corpus.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "with", "was", "are", "be", "this", "by", "on", "at", "or", "from",
    "der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "für", "sich", "nicht", "ein", "eine", "dem", "des", "auf",
    "de", "la", "le", "les", "et", "en", "un", "une", "du", "que", "qui", "dans", "pour", "par", "est", "au",
    "el", "los", "las", "y", "del", "se", "por", "con", "para", "su", "al", "es", "lo",
]

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document fails if ``metric`` is below ``low`` or above ``high``, judged only
    when it has at least ``from_words`` words."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


BASE_RULES = [
    Rule("too_short", "n_words", low=20),
    Rule("repeats_itself", "repeat_percent", high=30),
]

RULES = [
    Rule("too_long", "n_words", high=200_000),
    Rule("short_words", "mean_word_chars", low=2.0),
    Rule("long_words", "mean_word_chars", high=14.0),
    Rule("symbols", "symbols_per_word", high=0.25),
    Rule("few_stop_words", "stop_word_share", low=0.01, from_words=60),
    Rule("shouting", "upper_share", high=0.5),
    Rule("repeated_lines", "dup_line_share", high=0.3),
]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, bound as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _doubler(step: int):
    """From hashes of ``step`` words to those of twice as many (short at the end)."""
    return lambda h: F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words covered by n-word windows that occur twice or more in the array.

    Windows are compared by 64-bit hashes, sorted with their positions, so the cost
    is n log n also for texts that repeat a great deal.
    """
    if n & (n - 1):
        raise ValueError("the window is a power of two")

    hashes, step = F.transform(words, lambda w: F.xxhash64(w)), 1
    while step < n:
        hashes = let(hashes, _doubler(step))
        step *= 2
    hashes = F.slice(hashes, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(
            ordered,
            lambda s: F.filter(
                s,
                lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
            ),
        )
        starts = F.sort_array(F.transform(starts, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("words"), F.lit(-n).alias("last"))
        return F.aggregate(
            starts,
            zero,
            lambda a, i: F.struct((a["words"] + F.least(F.lit(n), i - a["last"])).alias("words"), i.alias("last")),
            lambda a: a["words"],
        )

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the metrics divide."""
    t = text_or_empty(text)
    split = docs.withColumn("__words", F.array_remove(F.split(t, ASCII_SPACE), "")).withColumn(
        "__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    words, lines = F.col("__words"), F.col("__lines")
    return split.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeated_words(words).cast("long"),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(sorted(set(STOP_WORDS))))).cast("long"),
            "n_upper": F.regexp_count(t, F.lit("[A-Z]")).cast("long"),
        }
    ).drop("__words", "__lines")


def metrics() -> dict[str, Column]:
    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "n_words": F.col("n_words").cast("double"),
        "repeat_percent": ratio("n_repeat_words", "n_words") * 100,
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "stop_word_share": ratio("n_stop_words", "n_words"),
        "upper_share": ratio("n_upper", "word_chars"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
    }


def compile_rules(rules: list[Rule]) -> list[Column]:
    """One boolean column per rule: true where a document fails it."""
    known, out = metrics(), []
    for r in rules:
        m = known[r.metric]
        fails = F.lit(False)
        if r.low is not None:
            fails = fails | (m < r.low)
        if r.high is not None:
            fails = fails | (m > r.high)
        out.append((fails & (F.col("n_words") >= r.from_words)).alias(r.name))
    return out


def apply_rules(docs: DataFrame, base: list[Rule] = BASE_RULES, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """Adds the counts, ``base_failed``, ``failed_rules`` (names) and ``kept``."""

    def names(which: list[Rule]) -> Column:
        flags = [F.when(c, F.lit(r.name)) for r, c in zip(which, compile_rules(which), strict=True)]
        return F.filter(F.array(*flags), lambda x: x.isNotNull())

    out = with_counts(docs, text).withColumns({"base_failed_rules": names(base), "failed_rules": names(rules)})
    return out.withColumn("base_failed", F.size("base_failed_rules") > 0).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
