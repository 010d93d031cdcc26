"""Quality rules as weak supervision: rules vote or abstain, EM finds how far each can be trusted.

Everything is built-in column work. The text is read once: its measures are
written to a narrow table, votes are counted by pattern (at most 3 to the power
of the number of rules, whatever the input), and expectation-maximisation runs
over the pattern table only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumforge.llm.common import SPACES, clashing, text_or_empty, written

#: Fixed values of the contract.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 8, 20, 30


@dataclass(frozen=True)
class Rule:
    """Votes for good where ``good`` holds, else against where ``bad`` holds, else abstains."""

    name: str
    good: str
    bad: str


#: Shares are of words or of characters in words. Measures: see ``measured``.
RULES = (
    Rule("symbols", "n_symbols * 200 <= word_chars", "n_symbols * 20 > word_chars"),
    Rule("repeats", "n_repeat_words * 20 <= n_words", "n_repeat_words * 4 > n_words"),
    Rule("lines", "n_dup_lines * 20 <= n_lines", "n_dup_lines > 2 AND n_dup_lines * 4 > n_lines"),
    Rule("shouting", "n_upper * 10 <= n_letters", "n_upper * 2 > n_letters"),
    Rule("marks", "n_marks * 20 <= word_chars", "n_marks * 10 > word_chars"),
    Rule("vocabulary", "n_distinct * 3 > n_words OR n_distinct > 150", "n_distinct * 8 < n_words AND n_distinct < 60"),
    Rule("word length", "word_chars BETWEEN 3 * n_words AND 9 * n_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule("length", "n_words >= 40", "n_words < 20"),
)


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The measures that the contract and the rules need, one row per row of ``docs``.

    A null text has no words; a null id stays; equal rows stay; other columns are left out.
    """
    text = clashing(docs, id_column, text_column).select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    stripped = text.select("doc_id", "text", F.btrim("text", F.lit(SPACES)).alias("inner"), F.split("text", "\n", -1).alias("lines"))
    split = stripped.select(
        "doc_id", "text",
        F.when(F.length("inner") == 0, F.array().cast("array<string>")).otherwise(F.split("inner", "[ \\t-\\r]+", -1)).alias("words"),
        F.filter("lines", lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("lines"))
    hashed = split.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    windows = hashed.select(
        *[c for c in hashed.columns if c != "h"],
        F.when(F.size("h") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.size("h") - WINDOW),
            lambda i: F.xxhash64(*[F.get(F.col("h"), i + k) for k in range(WINDOW)]))).alias("w"))
    # Sorting windows with their places costs far more than finding that none repeats, which is the usual case.
    placed = windows.withColumn("sorted", F.when(
        F.size(F.array_distinct("w")) < F.size("w"), F.array_sort(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twice = placed.withColumn("places", F.when(F.col("sorted").isNotNull(), F.array_sort(F.transform(
        F.filter("sorted", lambda s, k: F.get(F.col("sorted"), k - 1)["x"].eqNullSafe(s["x"]) | F.get(F.col("sorted"), k + 1)["x"].eqNullSafe(s["x"])),
        lambda s: s["i"]))))
    none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
    covered = F.aggregate("places", none, lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum")), lambda a: a["sum"])

    def without(pattern: str) -> Column:
        return (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")

    return twice.select(
        "doc_id", "n_words", "n_distinct", "n_lines", "n_dup_lines",
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        without("\\p{Lu}+").alias("n_upper"), without("\\p{L}+").alias("n_letters"), without("[^\\p{L}\\p{N}\\s]+").alias("n_marks"))


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """1, 0 or null (abstains) for each rule."""
    return [F.expr(f"CASE WHEN {r.good} THEN 1 WHEN {r.bad} THEN 0 END").alias(f"v{i}") for i, r in enumerate(rules)]


@dataclass(frozen=True)
class Trust:
    """What EM found: per rule, how often it votes for good documents and against bad ones when it votes; share of good ones."""

    for_good: tuple[float, ...]
    against_bad: tuple[float, ...]
    share: float


def log_odds(trust: Trust) -> Column:
    """Log odds of good, from the columns v0, v1, …; a rule that abstains adds nothing."""
    weighed = [F.when(F.col(f"v{i}") == 1, log(g / (1 - b))).when(F.col(f"v{i}") == 0, log((1 - g) / b)).otherwise(0.0)
               for i, (g, b) in enumerate(zip(trust.for_good, trust.against_bad, strict=True))]
    return reduce(Column.__add__, weighed, F.lit(log(trust.share / (1 - trust.share))))


def posterior(trust: Trust) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds(trust)))


def _between(x: float, least: float, most: float) -> float:
    return min(most, max(least, x))


def trusted(patterns: DataFrame, n_rules: int, rounds: int = 25, for_good: float = 0.97, against_bad: float = 0.4, share: float = 0.85) -> Trust:
    """Accuracies and share by EM over counted vote patterns (columns v0, v1, … and n), from the given start.

    The two accuracies are apart since most rules look for one fault only: they
    vote for nearly every document, bad ones included, but a vote against says
    much. Bounds keep rules from being read backwards; ten seen votes on either
    side hold a rule that hardly votes near its start.
    """
    trust = Trust((for_good,) * n_rules, (against_bad,) * n_rules, share)
    for _ in range(rounds):
        p = patterns.withColumn("p", posterior(trust))
        sums = []
        for i in range(n_rules):
            cast = F.col(f"v{i}").isNotNull()
            sums += [F.sum(F.when(F.col(f"v{i}") == 1, F.col("p") * F.col("n"))).alias(f"g{i}"),
                     F.sum(F.when(F.col(f"v{i}") == 0, (1 - F.col("p")) * F.col("n"))).alias(f"b{i}"),
                     F.sum(F.when(cast, F.col("p") * F.col("n"))).alias(f"gc{i}"),
                     F.sum(F.when(cast, (1 - F.col("p")) * F.col("n"))).alias(f"bc{i}")]
        row = p.agg(F.sum(F.col("p") * F.col("n")).alias("good"), F.sum("n").alias("all"), *sums).first()
        if not row["all"]:
            break
        new = Trust(
            tuple(_between(((row[f"g{i}"] or 0) + 10 * for_good) / ((row[f"gc{i}"] or 0) + 10), 0.9, 0.999) for i in range(n_rules)),
            tuple(_between(((row[f"b{i}"] or 0) + 10 * against_bad) / ((row[f"bc{i}"] or 0) + 10), 0.15, 0.95) for i in range(n_rules)),
            _between(row["good"] / row["all"], 0.5, 0.99))
        moved = max(abs(x - y) for x, y in zip((*new.for_good, *new.against_bad, new.share), (*trust.for_good, *trust.against_bad, trust.share), strict=True))
        trust = new
        if moved < 1e-3:
            break
    return trust


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES,
                  least: float = 0.5) -> DataFrame:
    """doc_id, the base measures, ``base_failed``, ``quality`` (posterior that the document is good) and ``kept``.

    ``kept`` is false where the base test fails, else whether the posterior is
    at least ``least``. A document with no words fails the base test. An empty
    table gives an empty result.
    """
    narrow = written(measured(docs, id_column, text_column).withColumn(
        "base_failed", F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")), "quality-measures")
    voted = narrow.select("*", *votes(rules))
    patterns = written(voted.groupBy(*[f"v{i}" for i in range(len(rules))]).agg(F.count(F.lit(1)).alias("n")), "quality-patterns")
    scored = voted.withColumn("quality", posterior(trusted(patterns, len(rules))))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept"), "quality")
