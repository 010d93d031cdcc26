"""Checks of photos, chapters, bursts, documents and surveys, on tables with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.catalog import views
from albumforge.catalog.clustering import gap_placed
from albumforge.catalog.registry import query
from albumforge.operators import chapters as ch
from albumforge.operators import checks as ck


@query("photo_problems", f"""WITH {views.V_PHOTOS},
p AS (SELECT library_id, photo_id AS key, ordinal AS i, quality, lat FROM v_photos)
SELECT library_id, key, 'id does not match key' AS problem FROM p WHERE i % 19 = 0
UNION ALL SELECT library_id, key, 'name missing' FROM p WHERE i % 23 = 0
UNION ALL SELECT library_id, key, 'coords incomplete' FROM p WHERE i % 29 = 0 AND lat IS NOT NULL
UNION ALL SELECT library_id, key, 'thumbnail is not a data URL' FROM p WHERE i % 31 = 0
UNION ALL SELECT library_id, key, 'failed flag missing' FROM p WHERE i % 37 = 0
UNION ALL SELECT library_id, key, 'quality outside 0-1' FROM p WHERE quality * 1.2e0 > 1
UNION ALL SELECT library_id, key, 'file reference left' FROM p WHERE i % 41 = 0""")
def photo_problems(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("ordinal")
    p = views.photos(spark, sf).withColumn("key", F.col("photo_id"))
    bad = p.withColumns({
        "photo_id": F.when(i % 19 == 0, "other").otherwise(F.col("photo_id")),
        "name": F.when(i % 23 != 0, F.col("name")), "lng": F.when(i % 29 != 0, F.col("lng")),
        "thumbnail_url": F.when(i % 31 == 0, "blob:1").when(i % 2 == 0, "data:x"),
        "thumbnail_failed": F.when(i % 37 != 0, F.lit(False)), "quality": F.col("quality") * 1.2,
        "file": F.when(i % 41 == 0, F.lit("f"))})
    return ck.photo_problems(bad)


@query("chapter_problems", f"""WITH {views.V_CHAPTERS},
m AS (SELECT library_id, chapter_id, c.cluster_idx, p.photo_id, p.ordinal FROM v_placed p JOIN v_chapters c USING (library_id, cluster_idx) WHERE cluster_idx % 5 > 0)
SELECT library_id, chapter_id, 'no photos' AS problem FROM v_chapters WHERE cluster_idx % 5 = 0
UNION ALL SELECT library_id, chapter_id, 'lead photo missing' FROM v_chapters WHERE cluster_idx % 7 = 0
UNION ALL SELECT library_id, chapter_id, 'lead photo not in chapter' FROM v_chapters WHERE cluster_idx % 7 <> 0 AND (cluster_idx % 5 = 0 OR cluster_idx % 11 = 0)
UNION ALL SELECT library_id, chapter_id, 'coords incomplete' FROM v_chapters WHERE cluster_idx % 13 = 0 AND lat IS NOT NULL
UNION ALL SELECT library_id, chapter_id, concat('unknown photo ', photo_id) FROM m WHERE ordinal % 50 = 0""")
def chapter_problems(spark: SparkSession, sf: str) -> DataFrame:
    placed = gap_placed(spark, sf)
    c = F.col("cluster_idx")
    chapters = ch.build_chapters(placed).withColumns({
        "hero_photo_id": F.when(c % 7 == 0, None).when(c % 11 == 0, "nobody").otherwise(F.col("hero_photo_id")),
        "lng": F.when(c % 13 != 0, F.col("lng"))})
    members = ch.chapter_photos(placed).where(c % 5 > 0)
    return ck.chapter_problems(chapters, members, views.photos(spark, sf).where("ordinal % 50 <> 0"))


V_GROUPS = """g AS (SELECT source AS library_id, doc_id, doc_id // 100 AS group_id, concat('p', doc_id // 100 * 100) AS rep_id,
       CASE WHEN doc_id % 100 = 0 THEN CASE WHEN doc_id % 700 = 0 THEN concat('p', doc_id) END
            WHEN doc_id % 97 = 0 THEN 'p1' ELSE concat('p', doc_id) END AS photo_id FROM documents)"""


@query("burst_problems", f"""WITH {V_GROUPS},
known AS (SELECT source AS library_id, concat('p', doc_id) AS id FROM documents WHERE doc_id % 53 <> 0),
reps AS (SELECT DISTINCT library_id, group_id, rep_id AS id FROM g),
cands AS (SELECT library_id, group_id, photo_id AS id FROM g WHERE photo_id IS NOT NULL)
SELECT library_id, group_id, concat('unknown representative ', id) AS problem FROM reps ANTI JOIN known USING (library_id, id)
UNION ALL SELECT library_id, group_id, concat('unknown candidate ', id) FROM cands ANTI JOIN known USING (library_id, id)
UNION ALL SELECT library_id, min(group_id), concat('in more than one place ', id) FROM (SELECT * FROM reps UNION ALL SELECT * FROM cands) GROUP BY library_id, id HAVING count(*) > 1
UNION ALL SELECT library_id, group_id, 'no candidates' FROM g GROUP BY 1, 2 HAVING count(photo_id) = 0
UNION ALL SELECT library_id, group_id, concat('candidate is the representative ', photo_id) FROM g WHERE photo_id = rep_id""")
def burst_problems(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    p = lambda n: F.concat(F.lit("p"), n.cast("string"))
    group = F.floor(i / 100)
    docs = views.table(spark, sf, "documents").select("source", "doc_id")
    bursts = docs.select(
        F.col("source").alias("library_id"), group.alias("group_id"), p(group * 100).alias("rep_id"),
        F.when(i % 100 == 0, F.when(i % 700 == 0, p(i))).when(i % 97 == 0, "p1").otherwise(p(i)).alias("photo_id"))
    photos = docs.where(i % 53 != 0).select(F.col("source").alias("library_id"), p(i).alias("photo_id"))
    return ck.burst_problems(bursts, photos)


@query("document_problems", """WITH d AS (SELECT c_custkey AS library_id, c_custkey % 9 AS f FROM customer)
SELECT library_id, 'version missing' AS problem FROM d WHERE f IN (1, 8)
UNION ALL SELECT library_id, 'generatedAt missing' FROM d WHERE f IN (2, 8)
UNION ALL SELECT library_id, 'photos missing' FROM d WHERE f IN (3, 8)
UNION ALL SELECT library_id, 'chapters missing' FROM d WHERE f IN (4, 8)
UNION ALL SELECT library_id, 'meta missing' FROM d WHERE f IN (5, 8)
UNION ALL SELECT library_id, 'totalPhotosInput not a number' FROM d WHERE f = 6
UNION ALL SELECT library_id, 'totalChapters not a number' FROM d WHERE f = 6
UNION ALL SELECT library_id, 'blob address' FROM d WHERE f = 7""")
def document_problems(spark: SparkSession, sf: str) -> DataFrame:
    f = F.col("c_custkey") % 9
    pick = lambda n, bad, good: F.when(f == n, F.lit(bad)).otherwise(F.lit(good))
    body = F.when(f == 8, F.lit("not json")).otherwise(F.concat(
        F.lit('{"version":'), pick(1, "1", '"1.0"'), F.lit(',"generatedAt":'), pick(2, "null", '"2024-01-01"'),
        F.lit(',"photos":'), pick(3, "5", "{}"), F.lit(',"chapters":'), pick(4, "{}", "[]"),
        F.lit(',"meta":'), F.when(f == 5, "null").when(f == 6, '{"totalChapters":"2"}').otherwise('{"totalPhotosInput":3,"totalChapters":2.5}'),
        F.lit(',"name":'), pick(7, '"blob:http"', '"x"'), F.lit("}")))
    return ck.document_problems(views.table(spark, sf, "customer").select(F.col("c_custkey").alias("library_id"), body.alias("body")))


@query("survey_check", """WITH s AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN '   ' WHEN c_custkey % 5 <> 1 THEN concat('  ', c_name, ' ') END AS raw,
         c_custkey % 61 AS photo_count, c_custkey % 70 AS t, c_custkey % 6 AS m FROM customer),
v AS (SELECT *, CASE WHEN m = 0 THEN NULL WHEN m = 5 THEN NULL WHEN m = 4 AND t % 2 = 1 THEN NULL WHEN m = 4 THEN t // 2 ELSE t END AS num FROM s)
SELECT k, trim(raw) AS clean_name, coalesce(trim(raw), '') <> '' AS name_ok,
       coalesce(num BETWEEN 1 AND greatest(1, photo_count), FALSE) AS target_ok,
       CASE WHEN num BETWEEN 1 AND greatest(1, photo_count) THEN CAST(num AS BIGINT) END AS target_count,
       CAST(least(30, greatest(1, photo_count)) AS BIGINT) AS default_target FROM v""")
def survey_check(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    t, m = k % 70, k % 6
    text = (F.when(m == 0, F.lit("")).when(m == 5, F.concat(t.cast("string"), F.lit("d")))
            .when(m == 4, (t / 2).cast("string")).otherwise(F.concat(F.lit(" "), t.cast("string"))))
    surveys = views.table(spark, sf, "customer").select(
        k.alias("k"), F.when(k % 5 == 0, "   ").when(k % 5 != 1, F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("trip_name"),
        text.alias("target_text"), (k % 61).alias("photo_count"))
    return ck.survey_check(surveys).select("k", "clean_name", "name_ok", "target_ok", "target_count", "default_target")
