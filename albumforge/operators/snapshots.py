"""Counts and score summaries after each stage, per library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumforge.functions.scores import half_up


def tag_snapshot(photos: DataFrame, library_id: str = "library_id") -> DataFrame:
    return photos.groupBy(library_id).agg(
        F.count("*").alias("photos"), F.count("ts").alias("with_date"),
        F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("with_gps"))


def dedup_snapshot(marked: DataFrame, library_id: str = "library_id") -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_count")
    return marked.groupBy(library_id).agg(count("kept"), count("exact"), count("burst"))


def vector_snapshot(photos: DataFrame, library_id: str = "library_id") -> DataFrame:
    return photos.groupBy(library_id).agg(
        F.count("embedding").alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("without"))


def cluster_snapshot(clustered: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Cluster index and size per cluster; joined to photos where a per-photo view is wanted."""
    return clustered.groupBy(library_id, "cluster_idx").agg(F.count("*").alias("cluster_size"))


def score_snapshot(photos: DataFrame, score: str, library_id: str = "library_id") -> DataFrame:
    """Scored and skipped photos, mean (3 decimals), lowest and highest score."""
    return photos.groupBy(library_id).agg(
        F.count(score).alias("scored"), F.count_if(F.col(score).isNull()).alias("skipped"),
        (half_up(F.avg(score) * 1000) / 1000).alias("avg_score"),
        F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def hero_snapshot(chapters: DataFrame, library_id: str = "library_id") -> DataFrame:
    return chapters.groupBy(library_id).agg(F.count("hero_photo_id").alias("heroes"))


def role_snapshot(chapter_photos: DataFrame, bursts: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Chapters, photos shown in them, and photos that are only burst candidates."""
    shown = chapter_photos.groupBy(library_id, "cluster_idx").agg(F.count("*").alias("_n")).groupBy(library_id).agg(
        F.count("*").alias("chapters"), F.sum("_n").alias("selected"))
    only = bursts.groupBy(library_id).agg(F.count("*").alias("burst_only"))
    return shown.join(only, library_id, "left").fillna(0, ["burst_only"])


def thumbnail_snapshot(photos: DataFrame, library_id: str = "library_id") -> DataFrame:
    failed = F.coalesce("thumbnail_failed", F.lit(False))
    return photos.groupBy(library_id).agg(
        F.count_if(~failed).alias("generated"), F.count_if(failed).alias("failed"))


def by_score(photos: DataFrame, score: Column) -> DataFrame:
    """Highest stage score first, photos without one last."""
    return photos.orderBy(score.desc_nulls_last())
