"""The photo, event and vector tables the registered queries run on, derived from the given files.

Every view exists twice: as a DataFrame here, and as a DuckDB CTE text used by
the reference SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.functions.times import instant_of


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", instant_of(F.col("ts")))


def photos(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    i = F.col("event_id")
    no_gps = i % 5 == 0
    return e.select(
        (F.col("user_id") % 10).alias("library_id"),
        i.alias("ordinal"),
        F.concat(F.lit("photo_"), i.cast("string")).alias("photo_id"),
        F.concat(F.lit("IMG_"), i.cast("string"), F.lit(".jpg")).alias("name"),
        F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"),
        F.when(~no_gps, -60.0 + (i * 7919 % 120000) / 1000.0).alias("lat"),
        F.when(~no_gps, -170.0 + (i * 104729 % 340000) / 1000.0).alias("lng"),
        F.when(F.col("event_type") != "signup", F.least(F.col("value") / 100.0, F.lit(1.0))).alias("quality"),
        F.when(i % 3 == 0, F.lit("portrait")).otherwise(F.lit("landscape")).alias("orientation"),
    )


V_PHOTOS = """v_photos AS (
  SELECT user_id % 10 AS library_id, event_id AS ordinal,
         concat('photo_', CAST(event_id AS VARCHAR)) AS photo_id,
         concat('IMG_', CAST(event_id AS VARCHAR), '.jpg') AS name,
         CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS ts,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE -60.0e0 + (event_id * 7919 % 120000) / 1000.0e0 END AS lat,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE -170.0e0 + (event_id * 104729 % 340000) / 1000.0e0 END AS lng,
         CASE WHEN event_type = 'signup' THEN NULL ELSE least(value / 100.0e0, 1.0e0) END AS quality,
         CASE WHEN event_id % 3 = 0 THEN 'portrait' ELSE 'landscape' END AS orientation
  FROM events)"""

# Chapters by 45-minute gap, as CTEs on top of v_photos.
V_GAPS = V_PHOTOS + """,
v_gap_marks AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY library_id ORDER BY ts, ordinal) > INTERVAL 45 MINUTE
                 THEN 1 ELSE 0 END AS starts
  FROM v_photos WHERE ts IS NOT NULL),
v_gap_dated AS (
  SELECT * EXCLUDE (starts), CAST(sum(starts) OVER (PARTITION BY library_id ORDER BY ts, ordinal) AS INT) AS cluster_idx
  FROM v_gap_marks),
v_clustered AS (
  SELECT * FROM v_gap_dated
  UNION ALL
  SELECT p.*, coalesce(m.last_idx + 1, 0) AS cluster_idx
  FROM v_photos p LEFT JOIN (SELECT library_id, max(cluster_idx) AS last_idx FROM v_gap_dated GROUP BY 1) m
       ON p.library_id = m.library_id
  WHERE p.ts IS NULL),
v_placed AS (
  SELECT *, row_number() OVER (PARTITION BY library_id, cluster_idx ORDER BY ts, ordinal) - 1 AS pos,
         count(*) OVER (PARTITION BY library_id, cluster_idx) AS cluster_size
  FROM v_clustered)"""

# Chapter rows on top of v_placed.
V_CHAPTERS = V_GAPS + """,
v_lat AS (SELECT library_id, cluster_idx, lat, row_number() OVER (PARTITION BY library_id, cluster_idx ORDER BY lat) - 1 AS r,
                 count(*) OVER (PARTITION BY library_id, cluster_idx) AS n FROM v_placed WHERE lat IS NOT NULL),
v_lng AS (SELECT library_id, cluster_idx, lng, row_number() OVER (PARTITION BY library_id, cluster_idx ORDER BY lng) - 1 AS r,
                 count(*) OVER (PARTITION BY library_id, cluster_idx) AS n FROM v_placed WHERE lng IS NOT NULL),
v_chapters AS (
  SELECT g.*, printf('chapter_%03d', g.cluster_idx + 1) AS chapter_id, v_lat.lat, v_lng.lng
  FROM (SELECT library_id, cluster_idx, count(*) AS photo_count,
               max(CASE WHEN pos = cluster_size // 2 THEN photo_id END) AS hero_photo_id,
               strftime(min(ts), '%Y-%m-%d') AS date
        FROM v_placed GROUP BY 1, 2) g
  LEFT JOIN v_lat ON v_lat.library_id = g.library_id AND v_lat.cluster_idx = g.cluster_idx AND v_lat.r = v_lat.n // 2
  LEFT JOIN v_lng ON v_lng.library_id = g.library_id AND v_lng.cluster_idx = g.cluster_idx AND v_lng.r = v_lng.n // 2)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """64 floats per row: block means, an 8 x 8 gray grid, or a vector, as the query needs."""
    i = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("library_id"), i.alias("ordinal"),
        F.concat(F.lit("photo_"), i.cast("string")).alias("photo_id"),
        F.concat(F.lit("IMG_"), i.cast("string"), F.lit(".jpg")).alias("name"),
        F.col("embedding").alias("blocks"),
    )


V_EMB = """v_emb AS (
  SELECT label AS library_id, vec_id AS ordinal, concat('photo_', CAST(vec_id AS VARCHAR)) AS photo_id,
         concat('IMG_', CAST(vec_id AS VARCHAR), '.jpg') AS name,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS blocks
  FROM embeddings)"""

V_HASH = V_EMB + """,
v_mid AS (SELECT *, (list_sort(blocks)[32] + list_sort(blocks)[33]) / 2 AS middle FROM v_emb),
v_hash AS (
  SELECT library_id, ordinal, photo_id, name,
         list_sum(list_transform(range(64), lambda i: CASE WHEN blocks[i + 1] > middle
                  THEN CAST(1 AS HUGEINT) << i ELSE CAST(0 AS HUGEINT) END)) AS h
  FROM v_mid)"""


def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: the text is the content, the source is the library."""
    return table(spark, sf, "documents").select(
        F.col("source").alias("library_id"), F.col("doc_id").alias("ordinal"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("photo_id"),
        F.encode(F.col("text"), "UTF-8").alias("content"),
    )


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Raw event columns plus the number inside props; metrics build their JSON from these."""
    return events(spark, sf).select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_type").alias("event_name"), F.col("ts").alias("server_ts"),
        F.regexp_replace("props", "[^0-9]", "").cast("int").alias("k"),
        "event_id", F.col("value").alias("ms"),
    )


V_TELEMETRY = """v_telemetry AS (
  SELECT concat('s', CAST(user_id AS VARCHAR)) AS session_id, event_type AS event_name, ts AS server_ts,
         CAST(regexp_replace(props, '[^0-9]', '', 'g') AS INT) AS k, event_id, value AS ms
  FROM events)"""


def selection(spark: SparkSession, sf: str) -> DataFrame:
    """Photos with an automatic and a final choice, from labelled documents."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("library_id"), F.col("doc_id").alias("photo_id"),
        F.when(F.col("quality").isNotNull(), F.least(F.col("n_chars") / 5000.0, F.lit(1.0))).alias("quality"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("auto"),
        F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("kept"),
    )


V_CONF = """v_conf AS (
  SELECT d.source AS library_id, d.doc_id AS photo_id,
         CASE WHEN l.quality IS NOT NULL THEN least(d.n_chars / 5000.0e0, 1.0e0) END AS quality,
         coalesce(l.quality = 1, FALSE) AS auto, coalesce(l.toxic = 0, FALSE) AS kept
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def quota_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters of a library are the languages of a source."""
    return (
        table(spark, sf, "documents").groupBy(F.col("source").alias("library_id"), F.col("lang").alias("chapter_id"))
        .agg(F.count("*").alias("photo_count"))
    )


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """Keep/remove presses from conversation turns: user on, assistant off, system flip."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("library_id"), F.col("turn").alias("seq"),
        (F.col("turn") % 3).alias("photo_id"),
        F.when(F.col("role") == "user", F.lit("on")).when(F.col("role") == "assistant", F.lit("off"))
        .otherwise(F.lit("flip")).alias("action"),
    )


V_ACTIONS = """v_actions AS (
  SELECT conv_id AS library_id, turn AS seq, turn % 3 AS photo_id,
         CASE role WHEN 'user' THEN 'on' WHEN 'assistant' THEN 'off' ELSE 'flip' END AS action
  FROM conversations)"""


def day_text(ts: str):
    return F.date_format(F.date_trunc("day", F.col(ts)), "yyyy-MM-dd")
