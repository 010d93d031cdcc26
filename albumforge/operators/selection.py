"""What was proposed against what was kept, and the cheap cut before costly scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumforge.functions.scores import progress_zone, quartile_bucket

CELLS = ("tp", "fp", "fn", "tn")
TOP_N_PER_CLUSTER = 3


def scoring_candidates(placed: DataFrame, top_n: int = TOP_N_PER_CLUSTER, variance: str = "variance",
                       has_file: str = "has_file", library_id: str = "library_id") -> DataFrame:
    """The ``top_n`` sharpest photos of each cluster that have a file.

    A cluster of at most ``top_n`` photos is taken whole, which the rank gives by
    itself. The rank filter limits each cluster before the shuffle.
    """
    w = Window.partitionBy(library_id, "cluster_idx").orderBy(
        F.coalesce(F.col(variance), F.lit(0.0)).desc(), F.col("pos").asc())
    return (
        placed.where(F.col(has_file)).withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= top_n).drop("_rank")
    )


def mark_choices(universe: DataFrame, auto: DataFrame, kept: DataFrame, keys=("library_id", "photo_id")) -> DataFrame:
    """Flags ``is_auto`` and ``is_kept`` for every curatable photo."""
    keys = list(keys)
    a = auto.select(*keys).distinct().withColumn("is_auto", F.lit(True))
    k = kept.select(*keys).distinct().withColumn("is_kept", F.lit(True))
    return universe.join(a, keys, "left").join(k, keys, "left").fillna(False, ["is_auto", "is_kept"])


def confusion_cell():
    return (
        F.when(F.col("is_auto") & F.col("is_kept"), "tp").when(F.col("is_auto"), "fp")
        .when(F.col("is_kept"), "fn").otherwise("tn")
    )


def quality_histogram(marked: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Sixteen bucket counts and the number of photos without a quality, per library."""
    bucket = quartile_bucket(F.col("quality"))
    cells = marked.withColumn("_cell", confusion_cell()).withColumn("_bucket", bucket)
    counts = [
        F.count_if((F.col("_cell") == c) & (F.col("_bucket") == q)).alias(f"{c}_q{q}")
        for c in CELLS for q in range(4)
    ]
    return cells.groupBy(library_id).agg(*counts, F.count_if(F.col("quality").isNull()).alias("null_quality"))


def kept_by_chapter(chapters: DataFrame, chapter_photos: DataFrame, kept: DataFrame,
                    library_id: str = "library_id") -> DataFrame:
    """Kept photos per chapter, 0 included."""
    keys = [library_id, "cluster_idx"]
    counts = chapter_photos.join(kept.select(library_id, "photo_id").distinct(), [library_id, "photo_id"], "left_semi")
    counts = counts.groupBy(*keys).agg(F.count("*").alias("kept"))
    return chapters.join(counts, keys, "left").fillna(0, ["kept"])


def curation_totals(chapters: DataFrame, starters: DataFrame, kept: DataFrame,
                    library_id: str = "library_id") -> DataFrame:
    """Per library: total target, photos kept by the user, distinct starters, and the progress zone."""
    targets = chapters.groupBy(library_id).agg(F.sum("target").alias("total_target"))
    distinct = lambda df, name: df.select(library_id, "photo_id").distinct().groupBy(library_id).agg(
        F.count("*").alias(name))
    joined = targets.join(distinct(kept, "total_kept"), library_id, "left").join(
        distinct(starters, "auto_kept"), library_id, "left").fillna(0, ["total_kept", "auto_kept"])
    return joined.withColumn("zone", progress_zone(F.col("total_kept"), F.col("total_target")))


def merged_ids(*sets: DataFrame, keys=("library_id", "photo_id")) -> DataFrame:
    """Distinct union of id sets."""
    keys = list(keys)
    out = sets[0].select(*keys)
    for other in sets[1:]:
        out = out.unionByName(other.select(*keys))
    return out.distinct()
