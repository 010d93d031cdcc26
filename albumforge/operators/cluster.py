"""Groups of photos by local day or by time gap.

Both work on a small table first: one row per (library, slot), where a slot is
a day or a stretch of ``gap`` length. Cluster numbers come from windows over
that table and are joined back to the photos.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumforge.functions.text import natural_key
from albumforge.functions.times import local_date
from albumforge.operators.ordering import largest_of, with_positions

DEFAULT_GAP_MINUTES = 45


def _number_slots(photos: DataFrame, slot: Column, breaks: Callable[[Column, Column], Column],
                  library_id: str) -> DataFrame:
    """Number runs of slots per library and give every photo its run number.

    ``breaks(previous_last, first)`` says whether a slot starts a new run.
    Photos without a slot (undated) are a run of their own, at the end. The run's
    photo count comes along as ``cluster_size``.
    """
    slotted = photos.withColumn("_slot", slot)
    us = F.unix_micros("ts")
    slots = slotted.groupBy(library_id, "_slot").agg(
        F.min(us).alias("_min"), F.max(us).alias("_max"), F.count("*").alias("_n"))
    w = Window.partitionBy(library_id).orderBy(F.col("_slot").asc_nulls_last())
    starts = (
        F.when(F.row_number().over(w) == 1, 0)
        .when(F.col("_slot").isNull(), 1)
        .when(breaks(F.lag("_max").over(w), F.col("_min")), 1)
        .otherwise(0)
    )
    numbered = (
        slots.withColumn("_start", starts)
        .withColumn("cluster_idx", F.sum("_start").over(w).cast("int"))
        .withColumn("cluster_size", F.sum("_n").over(Window.partitionBy(library_id, "cluster_idx")))
        .select(F.col(library_id).alias("_lib"), F.col("_slot").alias("_key"), "cluster_idx", "cluster_size")
    )
    on = (F.col(library_id) == F.col("_lib")) & F.col("_slot").eqNullSafe(F.col("_key"))
    return slotted.join(numbered, on).drop("_slot", "_lib", "_key")


def day_clusters(photos: DataFrame, tz: str = "UTC", library_id: str = "library_id") -> DataFrame:
    """One cluster per local calendar day; undated photos last."""
    return _number_slots(photos, local_date(F.col("ts"), tz), lambda last, first: F.lit(True), library_id)


def gap_clusters(photos: DataFrame, gap_minutes: float = DEFAULT_GAP_MINUTES,
                 library_id: str = "library_id") -> DataFrame:
    """A new cluster wherever the time to the photo before is more than the gap.

    A slot is one gap long, so photos of one slot are never split, and whether
    two neighbouring slots are split depends on their last and first photo only.
    """
    gap = int((gap_minutes or DEFAULT_GAP_MINUTES) * 60_000_000)
    us = F.unix_micros("ts")
    slot = us - F.pmod(us, F.lit(gap))
    return _number_slots(photos, slot, lambda last, first: first - last > gap, library_id)


def cluster(photos: DataFrame, strategy: str = "day", gap_minutes: float | None = None,
            tz: str = "UTC", library_id: str = "library_id") -> DataFrame:
    """Day clusters unless the strategy is 'timeGap'."""
    if strategy == "timeGap":
        return gap_clusters(photos, gap_minutes or DEFAULT_GAP_MINUTES, library_id)
    return day_clusters(photos, tz, library_id)


def place_in_clusters(clustered: DataFrame, library_id: str = "library_id",
                      by_name: bool = True) -> DataFrame:
    """Add ``pos`` (0-based) and ``cluster_size``: by time, then natural name, then input order."""
    keyed = clustered.withColumn("_name", natural_key(F.col("name"))) if by_name else clustered
    order = [F.col("ts").asc_nulls_last()] + ([F.col("_name").asc_nulls_first()] if by_name else [])
    sized = "cluster_size" in clustered.columns
    placed = with_positions(keyed, [library_id, "cluster_idx"], [*order, F.col("ordinal").asc()],
                            size=None if sized else "cluster_size", largest=largest_of(clustered, "cluster_size"))
    return placed.drop("_name")
