"""From chapters to a story: places, distances, names, card layouts and frames.

Chapter tables are already aggregated, so windows over the chapters of a library
are small. Photos are only touched by rank filters that Spark limits per group
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumforge.functions import text as tx
from albumforge.functions.geo import coordinate_key, haversine_km
from albumforge.functions.scores import half_up

# The distance from which it makes the headline, and frame times.
DISTANCE_THRESHOLD_KM = 50
FRAME_MS = {"cover": None, "chapterDivider": 2000, "photoCard": 2000, "coda": 2000}


def travelled_km(chapters: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Rounded sum of the distances between neighbouring chapters; a pair without coordinates counts 0."""
    w = Window.partitionBy(library_id).orderBy("cluster_idx")
    leg = haversine_km(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    legs = chapters.withColumn("_leg", leg)
    return legs.groupBy(library_id).agg(half_up(F.coalesce(F.sum("_leg"), F.lit(0.0))).cast("bigint").alias("distance_km"))


def headline(distance_km: Column, photos: Column, threshold: int = DISTANCE_THRESHOLD_KM) -> Column:
    far = F.concat(F.format_number(distance_km, 0), F.lit("km travelled"))
    few = F.concat(F.format_number(photos, 0), F.when(photos == 1, " photo taken").otherwise(" photos taken"))
    return F.struct(
        F.when(distance_km >= threshold, "distance").otherwise("photo_count").alias("kind"),
        F.when(distance_km >= threshold, distance_km).otherwise(photos).alias("raw"),
        F.when(distance_km >= threshold, far).otherwise(few).alias("value"))


def place_table(addresses: DataFrame) -> DataFrame:
    """Label and country per coordinate key, from address parts."""
    part = lambda c: F.col(c) if c in addresses.columns else F.lit(None).cast("string")
    label = tx.place_label(*[part(c) for c in ("neighbourhood", "suburb", "quarter", "town", "city", "village",
                                               "municipality", "country")])
    return addresses.select("coord_key", label.alias("label"), F.nullif("country", F.lit("")).alias("country"))


def wanted_keys(chapters: DataFrame) -> DataFrame:
    """Each rounded position once: what a place lookup has to answer."""
    return chapters.where(F.col("lat").isNotNull()).select(
        coordinate_key(F.col("lat"), F.col("lng")).alias("coord_key")).distinct()


def locate_chapters(chapters: DataFrame, places: DataFrame) -> DataFrame:
    """Add ``label``, ``country`` and ``has_location``; chapters without coordinates or answer stay bare."""
    known = wanted_keys(chapters).join(places, "coord_key").withColumn("_found", F.lit(True))
    key = F.when(F.col("lat").isNotNull(), coordinate_key(F.col("lat"), F.col("lng")))
    return (
        chapters.withColumn("coord_key", key).join(known, "coord_key", "left")
        .withColumn("has_location", F.coalesce("_found", F.lit(False))).drop("_found", "coord_key")
    )


def main_country(located: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Most common country; the one seen first wins a tie."""
    counts = located.where(F.col("country").isNotNull()).groupBy(library_id, "country").agg(
        F.count("*").alias("_n"), F.min("cluster_idx").alias("_first"))
    best = F.max(F.struct("_n", (-F.col("_first")).alias("_early"), "country"))
    return counts.groupBy(library_id).agg(best["country"].alias("country"))


def last_country(located: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Country of the last chapter that has one: what a curated story is rebuilt with."""
    return located.where(F.col("country").isNotNull()).groupBy(library_id).agg(
        F.max_by("country", "cluster_idx").alias("country"))


def trip_title(survey_name: Column, story_name: Column, first_country: Column) -> Column:
    set_ = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(set_(survey_name), set_(story_name), set_(first_country), F.lit("trip"))


def divider_photos(photos: DataFrame, keys=("library_id", "cluster_idx")) -> DataFrame:
    """The two best photos of each chapter (missing quality counts 0); one photo serves twice."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce("quality", F.lit(0.0)).desc(), F.col("pos").asc())
    best = photos.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= 2)
    at = lambda n: F.max(F.when(F.col("_rank") == n, F.col("photo_id")))
    return best.groupBy(*keys).agg(at(1).alias("top_photo_id"), F.coalesce(at(2), at(1)).alias("bottom_photo_id"))


def card_layouts(photos: DataFrame, chapters: DataFrame, keys=("library_id", "cluster_idx")) -> DataFrame:
    """Layout and up to four photos per chapter.

    ``photos`` has ``orientation`` (display orientation) and ``quality``;
    ``chapters`` has ``hero_photo_id``. Three others per orientation are enough
    to decide. A chapter whose lead photo is not among its photos has no layout.
    """
    keys = list(keys)
    joined = photos.drop("hero_photo_id").join(chapters.select(*keys, "hero_photo_id"), keys)
    heroes = joined.where(F.col("photo_id") == F.col("hero_photo_id")).select(
        *keys, F.col("photo_id").alias("_hero"), F.col("orientation").alias("_side"))
    w = Window.partitionBy(*keys, "orientation").orderBy(F.coalesce("quality", F.lit(0.0)).desc(), F.col("pos").asc())
    others = (
        joined.where((F.col("photo_id") != F.col("hero_photo_id")) & F.col("orientation").isin("portrait", "landscape"))
        .withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= 3)
    )
    pick = lambda side, n: F.max(F.when((F.col("orientation") == side) & (F.col("_rank") == n), F.col("photo_id")))
    ranked = others.groupBy(*keys).agg(*[
        pick(side, n).alias(f"_{side[0]}{n}") for side in ("portrait", "landscape") for n in (1, 2, 3)])
    side = F.col("_side")
    p1, p2, p3, l1, l2 = (F.col(c) for c in ("_p1", "_p2", "_p3", "_l1", "_l2"))
    hero = F.col("_hero")
    upright, flat = side == "portrait", side == "landscape"
    card = lambda layout, *ids: F.struct(F.lit(layout).alias("layout"), F.array(*ids).alias("photo_ids"))
    chosen = (
        F.when(upright & p3.isNotNull(), card("portrait-4", hero, p1, p2, p3))
        .when(flat & l2.isNotNull(), card("landscape-3", hero, l1, l2))
        .when(upright & p1.isNotNull() & l1.isNotNull(), card("mixed-2p-1l", hero, p1, l1))
        .when(flat & p2.isNotNull(), card("mixed-2p-1l", p1, p2, hero))
        .when(flat & l1.isNotNull(), card("landscape-2", hero, l1))
        .otherwise(card("portrait-1", hero))
    )
    decided = heroes.join(ranked, keys, "left").withColumn("_card", chosen)
    decided = decided.select(*keys, F.col("_card.layout").alias("layout"), F.col("_card.photo_ids").alias("photo_ids"))
    return chapters.select(*keys, "hero_photo_id").join(decided, keys, "left").withColumn(
        "problem", F.when(F.col("layout").isNull(), F.lit("lead photo not in chapter")))


def name_chapters(located: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Day index and title; the index counts the chapters that are left."""
    w = Window.partitionBy(library_id).orderBy("cluster_idx")
    day = located.withColumn("day_index", F.row_number().over(w))
    return day.withColumn("title", tx.chapter_title(F.col("day_index"), F.col("label")))


def frames(named: DataFrame, dividers: DataFrame, cards: DataFrame, stories: DataFrame,
           library_id: str = "library_id") -> DataFrame:
    """The frame table: cover, a divider and a card per chapter, coda.

    ``named`` comes from ``name_chapters``; ``stories`` has one row per library
    with ``trip_name`` and ``stat``.
    """
    keys = [library_id, "cluster_idx"]
    day = F.col("day_index")
    counts = named.groupBy(library_id).agg(F.max("day_index").alias("_n"))
    base = named.select(*keys, "chapter_id", "day_index", "title")
    cover = stories.select(
        library_id, F.lit(0).alias("frame_no"), F.lit("frame_cover").alias("frame_id"), F.lit("cover").alias("type"),
        "trip_name", "stat")
    divider = base.join(dividers, keys).select(
        library_id, (2 * day - 1).alias("frame_no"), F.concat(F.lit("frame_divider_"), "chapter_id").alias("frame_id"),
        F.lit("chapterDivider").alias("type"), "chapter_id", "day_index", "title", "top_photo_id", "bottom_photo_id")
    card = base.join(cards, keys).select(
        library_id, (2 * day).alias("frame_no"), F.concat(F.lit("frame_photocard_"), "chapter_id").alias("frame_id"),
        F.lit("photoCard").alias("type"), "chapter_id", "layout", "photo_ids")
    coda = stories.join(counts, library_id, "left").select(
        library_id, (2 * F.coalesce("_n", F.lit(0)) + 1).alias("frame_no"), F.lit("frame_coda").alias("frame_id"),
        F.lit("coda").alias("type"), F.lit("The end.").alias("text"))
    out = cover
    for part in (divider, card, coda):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def frame_starts(frame_table: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Start of each frame in ms after leaving the cover, which waits for the viewer.

    Frames are two per chapter, so the window stays as small as the chapter table.
    """
    length = F.coalesce(*[F.when(F.col("type") == t, F.lit(ms)) for t, ms in FRAME_MS.items() if ms])
    w = Window.partitionBy(library_id).orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    timed = frame_table.withColumn("duration_ms", length)
    start = F.when(F.col("type") != "cover", F.coalesce(F.sum("duration_ms").over(w), F.lit(0)))
    return timed.withColumn("start_ms", start)
