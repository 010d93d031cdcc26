"""Lead photos and chapter rows, from aggregates and filters over placed photos."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumforge.functions.text import padded
from albumforge.functions.times import local_date
from albumforge.operators.ordering import rank_values

# Degrees per histogram bucket when the median coordinate is looked up.
COORD_BUCKET = 0.001


def middle_photo(pos: str = "pos", size: str = "cluster_size", photo: str = "photo_id") -> Column:
    return F.max(F.when(F.col(pos) == F.floor(F.col(size) / 2), F.col(photo)))


def first_date(tz: str, pos: str = "pos") -> Column:
    """Aggregate: local date of the first dated photo of the group, as text."""
    first = F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col(pos)))
    return F.date_format(local_date(first, tz), "yyyy-MM-dd")


def best_photo(placed: DataFrame, score: str, out: str, keys: Sequence[str]) -> DataFrame:
    """Photo with the highest score of each group; the first one wins ties."""
    top = F.min(F.struct((-F.col(score)).alias("s"), "pos", F.col("photo_id").alias("id")))
    return placed.where(F.col(score) > -1).groupBy(*keys).agg(top["id"].alias(out))


def select_heroes(placed: DataFrame, highlight_dates: Sequence[str] = (), tz: str = "UTC",
                  library_id: str = "library_id", aesthetic: str = "aesthetic_score",
                  quality: str = "quality") -> DataFrame:
    """One lead photo per cluster.

    Highest aesthetic score (first wins); else, on a highlight date, highest
    quality; else the middle photo.
    """
    keys = [library_id, "cluster_idx"]
    # Fixed-width aggregates stay in hash aggregation; the middle photo is a filter, not an aggregate.
    picks = placed.groupBy(*keys).agg(F.count("*").alias("photo_count"), first_date(tz).alias("date"))
    middle = placed.where(F.col("pos") == F.floor(F.col("cluster_size") / 2)).select(
        *keys, F.col("photo_id").alias("_middle"))
    picks = picks.join(middle, keys)
    hero = F.col("_middle")
    if highlight_dates and quality in placed.columns:
        picks = picks.join(best_photo(placed, quality, "_quality", keys), keys, "left")
        hero = F.coalesce(F.when(F.col("date").isin(list(highlight_dates)), F.col("_quality")), hero)
    if aesthetic in placed.columns:
        picks = picks.join(best_photo(placed, aesthetic, "_aesthetic", keys), keys, "left")
        hero = F.coalesce(F.col("_aesthetic"), hero)
    return picks.withColumn("hero_photo_id", hero).drop("_aesthetic", "_quality", "_middle")


def median_coords(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upper median of latitude and of longitude, each on its own; groups without coordinates drop out."""
    keys = list(keys)
    axes = F.array(*[F.struct(F.lit(a).alias("_axis"), F.col(a).alias("_deg")) for a in ("lat", "lng")])
    located = placed.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(*keys, F.inline(axes))
    upper = rank_values(located, [*keys, "_axis"], "_deg", {"v": F.floor(F.col("n") / 2)}, COORD_BUCKET)
    return upper.groupBy(*keys).agg(*[F.max(F.when(F.col("_axis") == a, F.col("v"))).alias(a) for a in ("lat", "lng")])


def chapter_id(cluster_idx: Column) -> Column:
    return F.concat(F.lit("chapter_"), padded(cluster_idx + 1, 3))


def build_chapters(placed: DataFrame, highlight_dates: Sequence[str] = (), tz: str = "UTC",
                   library_id: str = "library_id") -> DataFrame:
    """Chapter rows: id, photo count, lead photo, date and median coordinates."""
    keys = [library_id, "cluster_idx"]
    return (
        select_heroes(placed, highlight_dates, tz, library_id)
        .join(median_coords(placed, keys), keys, "left")
        .withColumn("chapter_id", chapter_id(F.col("cluster_idx")))
    )


def chapter_photos(placed: DataFrame, library_id: str = "library_id") -> DataFrame:
    """The ordered photo list of every chapter, one row per photo."""
    return placed.withColumn("chapter_id", chapter_id(F.col("cluster_idx")))


def live_bursts(bursts: DataFrame, chapter_photos: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Burst rows whose representative is in a chapter."""
    reps = chapter_photos.select(library_id, F.col("photo_id").alias("rep_id"))
    return bursts.join(reps, [library_id, "rep_id"], "left_semi")


def number_chapters(chapters: DataFrame, library_id: str = "library_id") -> DataFrame:
    """1-based day index by chapter order. Chapters are few per library, so this window is small."""
    w = Window.partitionBy(library_id).orderBy("cluster_idx")
    return chapters.withColumn("day_index", F.row_number().over(w))


def look_up_photos(listed: DataFrame, photos: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Photo rows of a chapter list (chapter_id, pos, photo_id); ids that are not known are dropped."""
    return listed.select(library_id, "chapter_id", "pos", "photo_id").join(photos, [library_id, "photo_id"])
