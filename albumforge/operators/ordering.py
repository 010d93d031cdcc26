"""Ordered work on groups of any size.

A plain ``Window.partitionBy(library_id)`` puts a whole library into one task.
One library may hold a third of all rows, so nothing here windows over a
library's photos directly:

* ``with_positions`` adds the exact rank of each row: by a window when the
  largest group is checked to be small, else by range-partitioning on (group,
  order), which cuts a big group over many tasks;
* ``neighbours`` and ``running`` work on fixed-size blocks of those ranks;
* ``rank_values`` picks exact order statistics from value counts, by splitting
  the bucket that holds a rank.

Plain windows are used where the group is a pre-aggregated table (chapters of a
library, days of a library) or where the filter ``row_number() <= n`` lets Spark
limit the group before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumforge.session import cut_lineage

BLOCK = 1_000_000
# Largest group, in rows, that a single task sorts in a plain window.
WINDOW_ROWS = 4_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest group: one aggregate over the key columns, combined before its shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _fits(df: DataFrame, keys: Sequence[str], window_rows: int | None, largest: int | None) -> bool:
    """Whether every group may be sorted by one task."""
    limit = WINDOW_ROWS if window_rows is None else window_rows
    return (largest_group(df, keys) if largest is None else largest) <= limit


def largest_of(df: DataFrame, size: str) -> int | None:
    """Largest value of a column that holds group sizes; None when there is no such column."""
    return (df.agg(F.max(size)).first()[0] or 0) if size in df.columns else None


def spread_sorted(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column],
                  partitions: int | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Total order over (keys, order_by), cut over tasks, with ``_part`` and ``_row``.

    ``_row`` grows with the order. The order must be unique inside a group
    (end it with ``ordinal``), so ties never move between tasks. The result is
    checkpointed: range bounds are sampled, and a second run of the plan could
    cut elsewhere. Without ``partitions`` the adaptive planner may join
    neighbouring small ranges.
    """
    cols = [F.col(k).asc_nulls_first() for k in keys] + list(order_by)
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return cut_lineage(
        ranged
        .sortWithinPartitions(*cols)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id())
        .drop(*drop)
    )


def with_positions(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column],
                   out: str = "pos", size: str | None = None,
                   partitions: int | None = None, window_rows: int | None = None,
                   largest: int | None = None) -> DataFrame:
    """Add the 0-based rank inside the group, and the group size when ``size`` is given.

    The order must be unique inside a group. ``largest`` is the size of the
    biggest group where the caller knows it; otherwise it is counted.
    """
    keys = list(keys)
    if keys and _fits(df, keys, window_rows, largest):
        group = Window.partitionBy(*keys)
        ranked = df.withColumn(out, (F.row_number().over(group.orderBy(*order_by)) - 1).cast("bigint"))
        return ranked.withColumn(size, F.count("*").over(group)) if size else ranked
    laid = spread_sorted(df, keys, order_by, partitions)
    # One row per (group, task): at most groups + tasks rows, so the windows
    # below see at most one row per task for any group.
    runs = laid.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    by_group = Window.partitionBy(*keys)
    before = F.sum("_n").over(by_group.orderBy("_part")) - F.col("_n")
    runs = runs.withColumn("_shift", before - F.col("_first"))
    if size:
        runs = runs.withColumn(size, F.sum("_n").over(by_group))
    runs = runs.drop("_first", "_n")
    placed = laid.join(runs, [*keys, "_part"])
    return placed.withColumn(out, F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def neighbours(df: DataFrame, keys: Sequence[str], pos: str = "pos",
               before: dict[str, str] | None = None, after: dict[str, str] | None = None,
               offset: int = 1, block: int = BLOCK) -> DataFrame:
    """``lag``/``lead`` by ``offset`` over dense positions, in blocks of at most ``block`` + 2 ``offset`` rows.

    ``before`` and ``after`` map new column names to source columns. Rows near
    the edge of a block are copied into the neighbouring block and dropped
    afterwards.
    """
    block = max(block, offset)
    home, place = F.floor(F.col(pos) / block), F.col(pos) % block
    blocks = F.filter(
        F.array(
            home,
            F.when(place >= block - offset, home + 1) if before else F.lit(None).cast("bigint"),
            F.when((place < offset) & (home > 0), home - 1) if after else F.lit(None).cast("bigint"),
        ),
        lambda b: b.isNotNull(),
    )
    spread = df.withColumn("_home", home).withColumn("_block", F.explode(blocks))
    w = Window.partitionBy(*keys, "_block").orderBy(pos)
    for name, src in (before or {}).items():
        spread = spread.withColumn(name, F.lag(src, offset).over(w))
    for name, src in (after or {}).items():
        spread = spread.withColumn(name, F.lead(src, offset).over(w))
    return spread.where(F.col("_home") == F.col("_block")).drop("_home", "_block")


def running(df: DataFrame, keys: Sequence[str], value: str, out: str, how: str = "sum",
            pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` up to and including the row, block by block."""
    fold = {"sum": F.sum, "max": F.max}[how]
    keys = list(keys)
    blocked = df.withColumn("_block", F.floor(F.col(pos) / block))
    totals = blocked.groupBy(*keys, "_block").agg(fold(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_block", fold("_total").over(earlier).alias("_carry"))
    inside = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = fold(value).over(inside)
    if how == "sum":
        both = F.coalesce(local, F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
    else:
        both = F.greatest(local, F.col("_carry"))
    return blocked.join(totals, [*keys, "_block"]).withColumn(out, both).drop("_block", "_carry")


def rank_values(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column],
                width: float, parts: int = 1024) -> DataFrame:
    """Exact order statistics of ``value`` per group, nulls ignored.

    ``ranks`` maps an output name to a 0-based rank given as an expression over
    ``n`` (the number of non-null values). Values are counted first, so repeats
    cost nothing after the map side. Then the bucket that holds a rank is found
    and split, twice: buckets ``width`` wide, then ``parts`` in each of those hit;
    only the values of the last ones are put in order. One path whatever the
    sizes, and no job runs while the plan is made: a window sees a group's
    buckets, a bucket's parts, or the distinct values of one part.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    place = F.col("_v") / width
    sized = counted.withColumn("_b0", F.floor(place)).withColumn(
        "_b1", F.floor((place - F.floor(place)) * parts))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()])
    whole = Window.partitionBy(*keys)
    tally = sized.groupBy(*keys, "_b0").agg(F.sum("_c").alias("_c"))
    hits = _holding(tally.withColumn("n", F.sum("_c").over(whole)).withColumn("_want", wanted).withColumn("_base", F.lit(0).cast("bigint")), keys, "_b0")
    inner = [*keys, "_b0"]
    parted = sized.join(hits.select(*inner, "_base", "_want"), inner)
    tally = parted.groupBy(*inner, "_b1").agg(F.sum("_c").alias("_c"), F.first("_base").alias("_base"), F.first("_want").alias("_want"))
    hits = _holding(tally, inner, "_b1")
    last = [*inner, "_b1"]
    found = _holding(sized.join(hits.select(*last, "_base", "_want"), last), last, "_v")
    named = found.select(*keys, "_v", F.explode("_want").alias("_w"))
    return named.groupBy(*keys).agg(*[F.max(F.when(F.col("_w.name") == name, F.col("_v"))).alias(name) for name in ranks])


def _holding(tally: DataFrame, group: Sequence[str], bucket: str) -> DataFrame:
    """The rows of ``tally`` (``_c`` values each, ``_base`` values before the group) that hold a wanted rank, with the values before them as ``_base``."""
    upto = F.sum("_c").over(Window.partitionBy(*group).orderBy(bucket))
    placed = tally.withColumn("_top", F.col("_base") + upto).withColumn("_base", F.col("_top") - F.col("_c"))
    held = F.filter("_want", lambda w: (w["rank"] >= F.col("_base")) & (w["rank"] < F.col("_top")))
    return placed.withColumn("_want", held).where(F.size("_want") > 0).drop("_top")
