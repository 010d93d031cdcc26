"""Sharing a target count over chapters, and the starter set it selects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumforge.operators.ordering import largest_of, with_positions


def allocate_targets(chapters: DataFrame, targets: DataFrame, library_id: str = "library_id",
                     order: str = "cluster_idx") -> DataFrame:
    """Largest-remainder shares of a library's target, capped by chapter size; adds ``target``.

    ``chapters`` has ``photo_count``; ``targets`` has ``total_photos`` (which may
    exceed the sum of the chapters) and ``target_count`` per library. What the
    whole shares leave over goes out one unit per chapter and pass, largest
    remainder first, until it is used up or every chapter is full. The number of
    complete passes follows from sorted free room, so nothing is repeated or
    exploded. Windows run over chapter rows.
    """
    lib = Window.partitionBy(library_id)
    n, total, wanted = F.col("photo_count"), F.col("total_photos"), F.col("target_count")
    cap = F.when(wanted > 0, F.least(wanted, total)).otherwise(F.lit(0))
    exact = n / total * F.col("_cap")
    shares = (
        chapters.join(targets, library_id)
        .withColumn("_cap", cap.cast("bigint"))
        .withColumn("_exact", F.coalesce(exact, F.lit(0.0)))
        .withColumn("_frac", F.col("_exact") - F.floor("_exact"))
        .withColumn("_base", F.least(n.cast("bigint"), F.floor("_exact")))
        .withColumn("_room", n - F.col("_base"))
        .withColumn("_left", F.col("_cap") - F.sum("_base").over(lib))
    )
    # Units placed once every chapter has got min(room, level), at each level that is some chapter's room.
    up_to = lib.orderBy("_room").rangeBetween(Window.unboundedPreceding, 0)
    placed = F.sum("_room").over(up_to) + (F.count("*").over(lib) - F.count("*").over(up_to)) * F.col("_room")
    levels = shares.withColumn("_placed", placed).withColumn(
        "_level", F.coalesce(F.max(F.when(F.col("_placed") <= F.col("_left"), F.col("_room"))).over(lib), F.lit(0))
    ).withColumn(
        "_used", F.coalesce(F.max(F.when(F.col("_placed") <= F.col("_left"), F.col("_placed"))).over(lib), F.lit(0))
    ).withColumn("_open", F.sum((F.col("_room") > F.col("_level")).cast("bigint")).over(lib))
    more = F.when(F.col("_open") > 0, F.floor((F.col("_left") - F.col("_used")) / F.col("_open"))).otherwise(F.lit(0))
    passes = levels.withColumn("_more", more).withColumn("_passes", F.col("_level") + F.col("_more")).withColumn(
        "_extra", F.col("_left") - F.col("_used") - F.col("_more") * F.col("_open"))
    still_open = F.col("_room") > F.col("_passes")
    turn = F.row_number().over(
        Window.partitionBy(library_id, still_open).orderBy(F.col("_frac").desc(), F.col(order).asc()))
    last_unit = F.when(still_open & (turn <= F.col("_extra")), 1).otherwise(0)
    return passes.withColumn(
        "target", (F.col("_base") + F.least("_room", "_passes") + last_unit).cast("bigint")
    ).select(*chapters.columns, "target")


def starter_set(chapter_photos: DataFrame, chapters: DataFrame, library_id: str = "library_id") -> DataFrame:
    """First ``target`` photos of each chapter: the lead photo, then by quality (missing = -1).

    ``chapters`` has ``hero_photo_id`` and ``target``. The cut differs per
    chapter, so photos get exact positions, which works for a chapter of any size.
    """
    keys = [library_id, "cluster_idx"]
    joined = chapter_photos.drop("hero_photo_id", "target").join(
        chapters.where(F.col("target") > 0).select(*keys, "hero_photo_id", "target"), keys)
    rest = F.coalesce("hero_photo_id", F.lit("")) != F.col("photo_id")
    order = [rest.cast("int").asc(), F.coalesce("quality", F.lit(-1.0)).desc(), F.col("pos").asc()]
    picked = with_positions(joined, keys, order, out="pick", largest=largest_of(chapters, "photo_count"))
    return picked.where(F.col("pick") < F.col("target"))


def fallback_starters(chapter_photos: DataFrame, chapters: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Without a survey target: the lead photo of each chapter, else its first photo."""
    keys = [library_id, "cluster_idx"]
    first = chapter_photos.where(F.col("pos") == 0).select(*keys, F.col("photo_id").alias("_first"))
    return chapters.join(first, keys).select(*keys, F.coalesce("hero_photo_id", "_first").alias("photo_id"))
