"""The side strip of a chapter: gaps and burst brackets between neighbouring photos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumforge.functions.text import gap_text
from albumforge.functions.times import epoch_ms, local_clock
from albumforge.operators.ordering import BLOCK, neighbours

GAP_MARK_MINUTES = 20


def strip_marks(placed: DataFrame, bursts: DataFrame | None = None, tz: str = "UTC",
                library_id: str = "library_id", block: int = BLOCK) -> DataFrame:
    """Per photo: clock text, minutes since the photo before, gap mark and text, burst start and end."""
    keys = [library_id, "cluster_idx"]
    rows = placed
    if bursts is not None:
        rows = rows.join(bursts.select(library_id, "photo_id", "burst"), [library_id, "photo_id"], "left")
    rows = rows.withColumn("_ms", epoch_ms(F.col("ts")))
    side = neighbours(rows, keys, before={"_before_ms": "_ms", "_before_burst": "burst"},
                      after={"_after_burst": "burst"}, block=block)
    dated = (F.col("_before_ms") != 0) & (F.col("_ms") != 0)
    gap = F.when(dated, F.abs(F.col("_ms") - F.col("_before_ms")) / 60000).otherwise(F.lit(0.0))
    in_burst = F.col("burst").isNotNull()
    return (
        side.withColumn("clock", local_clock(F.col("ts"), tz))
        .withColumn("gap_minutes", gap)
        .withColumn("gap_mark", F.col("gap_minutes") >= GAP_MARK_MINUTES)
        .withColumn("gap_text", F.when(F.col("gap_mark"), gap_text(F.col("gap_minutes"))))
        .withColumn("burst_start", in_burst & ~F.col("burst").eqNullSafe(F.col("_before_burst")))
        .withColumn("burst_end", in_burst & ~F.col("burst").eqNullSafe(F.col("_after_burst")))
        .drop("_before_ms", "_before_burst", "_after_burst")
        .withColumnRenamed("_ms", "epoch_ms")
    )
