"""Clusters, positions, lead photos and chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.catalog import views
from albumforge.catalog.registry import query
from albumforge.operators import chapters as ch
from albumforge.operators import cluster as cl
from albumforge.session import cut_lineage


def gap_placed(spark: SparkSession, sf: str) -> DataFrame:
    """Placed photos, written once because the queries on top read them several times."""
    return cut_lineage(cl.place_in_clusters(cl.gap_clusters(views.photos(spark, sf))))


@query("chapters_by_gap", f"""WITH {views.V_CHAPTERS}
SELECT library_id, chapter_id, photo_count, hero_photo_id, date, round(lat, 6) AS lat, round(lng, 6) AS lng
FROM v_chapters""")
def chapters_by_gap(spark: SparkSession, sf: str) -> DataFrame:
    return ch.build_chapters(gap_placed(spark, sf)).select(
        "library_id", "chapter_id", "photo_count", "hero_photo_id", "date",
        F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("gap_clusters", f"""WITH {views.V_GAPS} SELECT library_id, photo_id, cluster_idx FROM v_clustered""")
def gap_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return cl.cluster(views.photos(spark, sf), "timeGap").select("library_id", "photo_id", "cluster_idx")


DAY_SQL = """v_days AS (
  SELECT library_id, day, CAST(row_number() OVER (PARTITION BY library_id ORDER BY day NULLS LAST) - 1 AS INT) AS cluster_idx
  FROM (SELECT DISTINCT library_id, CAST(ts {shift} AS DATE) AS day FROM v_photos)),
v_by_day AS (
  SELECT p.*, d.cluster_idx FROM v_photos p JOIN v_days d
  ON p.library_id = d.library_id AND CAST(p.ts {shift} AS DATE) IS NOT DISTINCT FROM d.day)"""


@query("day_clusters", f"""WITH {views.V_PHOTOS}, {DAY_SQL.format(shift='')}
SELECT library_id, photo_id, cluster_idx FROM v_by_day""")
def day_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return cl.cluster(views.photos(spark, sf), "day").select("library_id", "photo_id", "cluster_idx")


@query("day_clusters_in_zone", f"""WITH {views.V_PHOTOS}, {DAY_SQL.format(shift="+ INTERVAL 9 HOUR")}
SELECT library_id, photo_id, cluster_idx FROM v_by_day""")
def day_clusters_in_zone(spark: SparkSession, sf: str) -> DataFrame:
    return cl.day_clusters(views.photos(spark, sf), "Asia/Tokyo").select("library_id", "photo_id", "cluster_idx")


@query("positions_in_clusters", f"""WITH {views.V_GAPS}
SELECT library_id, photo_id, cluster_idx, pos, cluster_size FROM v_placed""")
def positions_in_clusters(spark: SparkSession, sf: str) -> DataFrame:
    placed = cl.place_in_clusters(cl.gap_clusters(views.photos(spark, sf)))
    return placed.select("library_id", "photo_id", "cluster_idx", "pos", "cluster_size")


@query("heroes_by_rule", f"""WITH {views.V_GAPS},
scored AS (SELECT *, CASE WHEN cluster_idx % 3 = 0 THEN quality END AS aesthetic FROM v_placed),
d AS (SELECT library_id, cluster_idx, strftime(min(ts), '%Y-%m-%d') AS date FROM v_placed GROUP BY 1, 2),
ranked AS (
  SELECT s.library_id, s.cluster_idx, s.photo_id, s.pos, s.cluster_size, s.aesthetic, s.quality, d.date,
         row_number() OVER (PARTITION BY s.library_id, s.cluster_idx ORDER BY s.aesthetic DESC NULLS LAST, s.pos) AS ra,
         row_number() OVER (PARTITION BY s.library_id, s.cluster_idx ORDER BY s.quality DESC NULLS LAST, s.pos) AS rq
  FROM scored s JOIN d ON s.library_id = d.library_id AND s.cluster_idx = d.cluster_idx)
SELECT library_id, cluster_idx, date,
       coalesce(max(CASE WHEN ra = 1 AND aesthetic IS NOT NULL THEN photo_id END),
                CASE WHEN date IN ('2024-01-03', '2024-01-10', '2024-01-21')
                     THEN max(CASE WHEN rq = 1 AND quality IS NOT NULL THEN photo_id END) END,
                max(CASE WHEN pos = cluster_size // 2 THEN photo_id END)) AS hero_photo_id
FROM ranked GROUP BY library_id, cluster_idx, date""")
def heroes_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    placed = gap_placed(spark, sf).withColumn(
        "aesthetic_score", F.when(F.col("cluster_idx") % 3 == 0, F.col("quality")))
    return ch.select_heroes(placed, ["2024-01-03", "2024-01-10", "2024-01-21"]).select(
        "library_id", "cluster_idx", "date", "hero_photo_id")


@query("median_coordinates", f"""WITH {views.V_CHAPTERS}
SELECT library_id, cluster_idx, round(lat, 6) AS lat, round(lng, 6) AS lng FROM v_chapters WHERE lat IS NOT NULL""")
def median_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    clustered = cl.gap_clusters(views.photos(spark, sf))
    return ch.median_coords(clustered, ["library_id", "cluster_idx"]).select(
        "library_id", "cluster_idx", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("chapter_day_index", f"""WITH {views.V_CHAPTERS}
SELECT library_id, chapter_id, row_number() OVER (PARTITION BY library_id ORDER BY cluster_idx) AS day_index
FROM v_chapters WHERE photo_count > 1""")
def chapter_day_index(spark: SparkSession, sf: str) -> DataFrame:
    sizes = cl.gap_clusters(views.photos(spark, sf)).groupBy("library_id", "cluster_idx").count().where("count > 1")
    return ch.number_chapters(sizes).select(
        "library_id", ch.chapter_id(F.col("cluster_idx")).alias("chapter_id"), "day_index")


@query("chapter_photo_rows", f"""WITH {views.V_GAPS}
SELECT library_id, printf('chapter_%03d', cluster_idx + 1) AS chapter_id, pos, photo_id, quality FROM v_placed WHERE ordinal % 8 > 0""")
def chapter_photo_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = views.photos(spark, sf)
    listed = ch.chapter_photos(gap_placed(spark, sf))
    return ch.look_up_photos(listed, p.where("ordinal % 8 > 0")).select("library_id", "chapter_id", "pos", "photo_id", "quality")
