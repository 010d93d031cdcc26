"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents share one copy rate r = target / source size. Every
document takes floor(r) copies; the rest f = r - floor(r) is a probability.
Two documents at a time, words are moved from one probability to the other at
random, in a way that keeps both expectations, until one of them is 0 or 1.
That leaves the source's expected words as they are, so what is taken misses
the target by less than one document. Groups of bounded size are rounded side
by side; the one document that each leaves undecided goes on to the next level
of the tree, until a source has one left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumforge.llm.common import SPACES, clashing, numbered, scanned, text_or_empty, written
from albumforge.llm.workers import lean_group

#: Weights by source, in code point order, repeated; share of all words to take; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Rows that one task rounds together; the tree's fan-in.
GROUP_ROWS = 8192


def word_count(column: str = "text"):
    """Words of the pattern [^\\x20\\x09-\\x0D]+; null has none."""
    inner = F.btrim(text_or_empty(column), F.lit(SPACES))
    return F.when(F.length(inner) == 0, F.lit(0)).otherwise(F.length(F.regexp_replace(inner, "[^ \\t-\\r]+[ \\t-\\r]*", "x"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: shares by weight, cut at ``most`` times the size, the excess dealt again by weight.

    Sources are numbered in code point order, null last; one row per source throughout.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    ordered = by_source.withColumn("_null", F.col("source").isNull()).withColumn("_one", F.lit(1))
    ranked = numbered(ordered, ["_null", "source"], "_one", "rank", "mix-sources")
    weighed = written(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))), "mix-weights")
    all_words = weighed.agg(F.sum("source_size")).first()[0] or 0
    # A source that the present level fills stays full: the level only rises.
    level = 0.0
    while True:
        full = F.col("weight") * level > most * F.col("source_size") if level else F.lit(False)
        row = weighed.agg(F.sum(F.when(full, most * F.col("source_size"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        new = max(0.0, share * all_words - (row["full"] or 0.0)) / row["open"]
        if new <= level * (1 + 1e-12):
            break
        level = new
    return weighed.select("source", "source_size", "source_rows", F.least(F.lit(float(most)) * F.col("source_size"), F.lit(level) * F.col("weight")).alias("target"))


def _draws(ids: np.ndarray, copies: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row, from its id, its place among equal rows and the seed only."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + copies.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def pivot(sizes: np.ndarray, shares: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Shares rounded to 0 or 1 but for one (its place, or -1), the sum of size * share kept."""
    p, held = shares.astype(float).copy(), -1
    for i in range(len(p)):
        if p[i] <= 1e-12 or p[i] >= 1 - 1e-12:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = sizes[held], sizes[i]
        up = min(a * (1 - p[held]), b * p[i])     # words that held can still take from i
        down = min(a * p[held], b * (1 - p[i]))   # words that held can still give to i
        moved = up if draws[i] * (up + down) < down else -down
        p[held] += moved / a
        p[i] -= moved / b
        for k in (held, i):
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = round(p[k])
        open_ = [k for k in (held, i) if 0 < p[k] < 1]
        held = open_[0] if open_ else -1
    return p, held


def _rounder(seed: int, last: bool):
    return lambda pdf: _round_group(pdf.drop(columns="group"), seed, last)


def _round_group(pdf: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    # Largest first: what stays undecided at the end is then a small document.
    pdf = pdf.sort_values(["size", "order", "doc_id", "copy"], ascending=[False, True, True, True]).reset_index(drop=True)
    draws = _draws(pdf["order"].to_numpy(np.int64), pdf["copy"].to_numpy(np.int64), seed)
    p, held = pivot(pdf["size"].to_numpy(float), pdf["part"].to_numpy(float), draws)
    done = np.ones(len(pdf), bool)
    if held >= 0:
        if last:
            p[held] = round(p[held])  # the nearer of the two: no more than half a document is missed
        else:
            done[held] = False
    pdf["part"], pdf["done"] = p, done
    return pdf


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", weights: tuple[int, ...] = WEIGHTS,
        share: float = SHARE, most: float = MOST, seed: int = 7, key_column: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (0 to ``most``) for every row, and its ``row_key`` where ``key_column`` (text) is given.

    Draws hang on the seed, the id and the place among equal rows, so reruns
    agree whatever the partitions. Null source: a source of its own, weighed last.
    Null ids take part like any other. A document without words is never drawn;
    a target of a source without words is 0. Rows of one id and size are rounded
    one by one, numbered by ranges, so any number of them may be equal. Of a very
    long text only the size goes on; other columns are left out.
    """
    # Ids travel as text: pandas would turn whole numbers next to a null into floats.
    key = F.lit(None).cast("string") if key_column is None else F.col(key_column)
    sized = clashing(docs, *dict.fromkeys([id_column, source_column, text_column, *([key_column] if key_column else [])])).select(
        F.col(id_column).cast("string").alias("doc_id"), F.col(source_column).alias("source"), word_count(text_column).alias("size"),
        key.alias("row_key"), F.xxhash64(text_column).alias("text_hash"))
    numbered_rows = written(sized.withColumn("equal", F.xxhash64("source", "doc_id", "size")).withColumn("one", F.lit(1).cast("long")).withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    counted = scanned(numbered_rows, "equal", ["source", "doc_id", "size", "text_hash", "row"], {"one": "add"}, "mix-sizes").withColumn("copy", F.col("run_one").cast("int"))
    goal = targets(counted, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    order = F.xxhash64("doc_id", "size")
    rated = counted.join(goal.withColumn("rate", rate), counted["source"].eqNullSafe(goal["source"]), "left").drop(goal["source"])
    base = rated.select("row_key", "doc_id", "source", "size", "source_size", "target", "source_rows", "copy", order.alias("order"),
                        F.floor("rate").cast("int").alias("whole"),
                        F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0).alias("part"))
    schema = "row_key string, doc_id string, source string, size long, source_size long, target double, source_rows long, copy int, order long, whole int, part double, done boolean"
    level, out, rows = 0, [], base
    while True:
        groups = F.ceil(F.col("source_rows") / GROUP_ROWS).cast("int")
        dealt = rows.withColumn("group", F.pmod(F.xxhash64("order", "copy", F.lit(level)), groups))
        most_groups = dealt.agg(F.max(groups)).first()[0] or 1
        rounded = written(dealt.groupBy("source", "group").applyInPandas(lean_group(_rounder(seed + level, most_groups <= 1)), schema), f"mix-level{level}")
        out.append(rounded.filter("done"))
        if most_groups <= 1:
            break
        # One row at most came through from each group.
        rows = rounded.filter("NOT done").withColumn("source_rows", groups.cast("long"))
        level += 1
    decided = out[0]
    for more in out[1:]:
        decided = decided.unionByName(more)
    return decided.select(F.col("doc_id").cast(docs.schema[id_column].dataType), "source", "size", "source_size", "target", (F.col("whole") + F.round("part").cast("int")).alias("copies"),
                          *(["row_key"] if key_column else []))
