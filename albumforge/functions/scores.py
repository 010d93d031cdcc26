"""Per-row scores, sizes and bands. JavaScript-style rounding: halves go up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest whole number, .5 towards plus infinity."""
    return F.floor(x + 0.5)


def sharpness_score(variance: Column) -> Column:
    """Sigmoid of a Laplacian variance centred at 200, 3 decimals; null stays null."""
    return half_up(1000 / (1 + F.exp(-0.01 * (variance - 200)))) / 1000


def quartile_bucket(q: Column) -> Column:
    # least and greatest skip nulls, so a missing score has to be kept out first
    return F.when(q.isNotNull(), F.least(F.lit(3), F.greatest(F.lit(0), F.floor(q * 4).cast("int"))))


def unit_clamp(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def display_orientation(explicit: Column, width: Column, height: Column) -> Column:
    return (
        F.when(explicit.isin("portrait", "landscape"), explicit)
        .when(width.isNull() | height.isNull(), F.lit(None).cast("string"))
        .when(height > width, F.lit("portrait"))
        .otherwise(F.lit("landscape"))
    )


def fit_box(width: Column, height: Column, box: int) -> Column:
    """Size that fits a square box, aspect kept, never enlarged."""
    wide, tall = (width > height) & (width > box), (width <= height) & (height > box)
    return F.struct(
        F.when(wide, F.lit(box)).when(tall, half_up(width * box / height)).otherwise(width).cast("bigint").alias("width"),
        F.when(tall, F.lit(box)).when(wide, half_up(height * box / width)).otherwise(height).cast("bigint").alias("height"),
    )


def scale_long_edge(width: Column, height: Column, edge: int) -> Column:
    """Size whose long edge is exactly ``edge`` (small pictures are enlarged)."""
    scale = F.lit(edge) / F.greatest(width, height)
    known = width.isNotNull() & height.isNotNull()
    at_least_one = lambda x: F.when(known, F.greatest(F.lit(1), half_up(x * scale))).cast("bigint")
    return F.struct(at_least_one(width).alias("width"), at_least_one(height).alias("height"))


def progress_zone(kept: Column, target: Column) -> Column:
    # 1.15 * target in whole numbers: kept <= ceil(115 t / 100)
    limit = F.ceil(target * 115 / 100)
    return (
        F.when(kept == 0, F.lit("empty"))
        .when(kept < target, F.lit("under"))
        .when(kept <= limit, F.lit("on"))
        .otherwise(F.lit("over"))
    )


def fallback_target(photos: Column) -> Column:
    """About a fifth of the chapter, at least 1 and at most 8."""
    return F.least(F.lit(8), F.greatest(F.lit(1), half_up(photos * 0.2))).cast("bigint")


def exposure_coverage(has_date: Column, has_gps: Column) -> Column:
    return F.when(has_date & has_gps, F.lit(1.0)).when(has_date, F.lit(0.6)).otherwise(F.lit(0.2))


def light_band(score: Column) -> Column:
    s = unit_clamp(score)
    return (
        F.when(score.isNull(), F.lit("none"))
        .when(s >= 0.7, F.lit("green"))
        .when(s >= 0.4, F.lit("amber"))
        .otherwise(F.lit("red"))
    )


def dedup_view_score(status: Column, distance: Column) -> Column:
    """Sort score of the duplicate view: kept 1, exact 0, burst 1 - d/20 (0.5 if unknown)."""
    return (
        F.when(status == "kept", F.lit(1.0))
        .when(status == "exact", F.lit(0.0))
        .when(status == "burst", F.when(distance.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), 1 - distance / 20)))
    )
