"""Uploads, tags and itineraries, built from pages, events and orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.catalog import views
from albumforge.catalog.event_intake import pick
from albumforge.catalog.registry import query
from albumforge.functions.times import instant_of
from albumforge.operators import itinerary as it
from albumforge.operators.dedup import fingerprint
from albumforge.session import cut_lineage, shared_dir
from albumforge.sources import itineraries, uploads

SUFFIXES = (".jpg", ".JPEG", ".png", ".gif", ".heic", ".txt", ".tiff", ".jpgx", "")


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files; the page length, scaled, is the file size, a 64-bit number: an int ends at pages of 107,374 characters."""
    p = views.table(spark, sf, "pages")
    i = F.col("page_id")
    return p.select((i % 3).alias("library_id"), i.alias("ordinal"),
                    F.concat(F.lit("img"), i.cast("string"), pick(SUFFIXES, i % 9)).alias("name"),
                    (F.length("html").cast("long") * 20000).alias("length"))


@query("accepted_uploads", f"""WITH f AS (
  SELECT page_id % 3 AS library_id, page_id AS ordinal, concat('img', page_id, {list(SUFFIXES)}[page_id % 9 + 1]) AS name,
         length(html) * 20000 AS length FROM pages),
g AS (SELECT *, CASE WHEN NOT regexp_matches(lower(name), '\\.(jpg|jpeg|png|heic|heif|webp|tiff)$') THEN 'type'
                     WHEN length > 52428800 THEN 'size' END AS fault FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY library_id, fault IS NULL ORDER BY ordinal) AS no FROM g)
SELECT library_id, ordinal, name, coalesce(fault, CASE WHEN no > 40 THEN 'count' END) AS reject_reason,
       fault IS NULL AND no <= 40 AS accepted FROM n""")
def accepted_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """With a limit of 40 files, so that uploads of the small tables meet it."""
    return uploads.accept_uploads(listing(spark, sf), most=40).select("library_id", "ordinal", "name", "reject_reason", "accepted")


def write_upload(spark: SparkSession, sf: str, path: str) -> None:
    """Every document as a file of its own, written by the tasks through the cluster's file system: lang/folder/id and one of the endings.

    The folders, one for every thousand ids, let the listing run in parallel.
    """
    docs = views.table(spark, sf, "documents").select(
        F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.lit("img"), F.col("doc_id").cast("string"), pick(SUFFIXES, F.col("doc_id") % 9))).alias("name"),
        F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    uploads.write_files(docs, path)


@query("listed_files", f"""WITH f AS (
  SELECT concat('img', doc_id, {list(SUFFIXES)}[doc_id % 9 + 1]) AS name, coalesce(text, '') AS x FROM documents),
g AS (SELECT * FROM f WHERE regexp_matches(lower(name), '[.](jpg|jpeg|png|heic|heif|webp|tiff)$') AND strlen(x) BETWEEN 1 AND 4000)
SELECT name, strlen(x) AS length, sha256(x) AS fingerprint FROM g""")
def listed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Real files of a folder: other endings are never listed, those above the limit (4,000 bytes here) never opened."""
    path = f"{shared_dir(spark)}/albumforge-upload-{uuid.uuid4().hex}"
    write_upload(spark, sf, path)
    return uploads.list_images(spark, path, 4000).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "length", fingerprint(F.col("content")).alias("fingerprint"))


def tags(spark: SparkSession, sf: str) -> DataFrame:
    e, i, ts = views.events(spark, sf), F.col("event_id"), F.col("ts")
    null = F.lit(None).cast("int")
    return e.select(
        (F.col("user_id") % 10).alias("library_id"), i.alias("ordinal"),
        F.concat(F.lit("IMG_"), i.cast("string"), F.lit(".jpg")).alias("name"), (i * 17).alias("size"),
        F.when(i % 3 != 0, ts).alias("date_time_original"),
        F.when(i % 2 != 0, ts + F.expr("INTERVAL 1 HOUR")).alias("create_date"),
        F.when(i % 7 != 0, ts + F.expr("INTERVAL 2 HOUR")).alias("modify_date"),
        F.when(i % 4 == 0, 0).otherwise(3000).alias("image_width"), F.when(i % 8 != 0, 4000).alias("exif_image_width"),
        F.lit(1200).alias("pixel_x_dimension"),
        F.when(i % 6 == 0, 0).alias("image_height"), null.alias("exif_image_height"),
        F.when(i % 5 != 0, 900).alias("pixel_y_dimension"),
        F.when(i % 5 != 0, (i % 90).cast("double")).alias("latitude"),
        F.when(i % 11 != 0, (i % 180).cast("double")).alias("longitude"),
        F.when(i % 2 == 0, "Acme").alias("make"))


TAGS_SQL = """v_tags AS (
  SELECT user_id % 10 AS library_id, event_id AS i,
         CASE WHEN event_id % 3 <> 0 THEN ts WHEN event_id % 2 <> 0 THEN ts + INTERVAL 1 HOUR
              WHEN event_id % 7 <> 0 THEN ts + INTERVAL 2 HOUR END AS taken FROM events)"""


@query("photo_rows", f"""WITH {TAGS_SQL}
SELECT library_id, concat('photo_', i) AS photo_id, concat('IMG_', i, '.jpg') AS name, i * 17 AS size,
       epoch_us(taken) AS ts_us,
       CASE WHEN i % 4 <> 0 THEN 3000 WHEN i % 8 <> 0 THEN 4000 ELSE 1200 END AS width,
       CASE WHEN i % 5 <> 0 THEN 900 END AS height,
       CASE WHEN i % 5 <> 0 AND i % 11 <> 0 THEN CAST(i % 90 AS DOUBLE) END AS lat,
       CASE WHEN i % 5 <> 0 AND i % 11 <> 0 THEN CAST(i % 180 AS DOUBLE) END AS lng,
       CASE WHEN i % 2 = 0 THEN 'Acme' END AS make, CAST(NULL AS VARCHAR) AS lens_model, FALSE AS thumbnail_failed
FROM v_tags""")
def photo_rows(spark: SparkSession, sf: str) -> DataFrame:
    return uploads.photo_rows(tags(spark, sf)).select(
        "library_id", "photo_id", "name", "size", F.unix_micros("ts").alias("ts_us"), "width", "height", "lat", "lng",
        "make", "lens_model", "thumbnail_failed")


@query("upload_metadata", """SELECT page_id % 3 AS library_id, page_id AS ordinal, concat('stored/', page_id) AS file_path, url AS original_name,
  CASE WHEN e.event_id % 3 <> 0 THEN epoch_us(ts) WHEN e.event_id % 2 <> 0 THEN epoch_us(ts + INTERVAL 1 HOUR)
       WHEN e.event_id % 7 <> 0 THEN epoch_us(ts + INTERVAL 2 HOUR) END AS ts_us
FROM pages p LEFT JOIN events e ON e.event_id = p.page_id AND e.user_id % 10 = p.page_id % 3""")
def upload_metadata(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    files = views.table(spark, sf, "pages").select(
        (i % 3).alias("library_id"), i.alias("ordinal"), F.concat(F.lit("f"), i.cast("string")).alias("filename"),
        F.col("url").alias("original_name"), F.concat(F.lit("stored/"), i.cast("string")).alias("file_path"))
    return uploads.upload_metadata(files, tags(spark, sf)).select(
        "library_id", "ordinal", "file_path", "original_name", F.unix_micros("timestamp").alias("ts_us"))


def itinerary_docs(spark: SparkSession, sf: str) -> DataFrame:
    """One itinerary document per customer; the orders are its events."""
    o = views.table(spark, sf, "orders").withColumn("o_orderdate", instant_of(F.col("o_orderdate")))
    k = F.col("o_orderkey")
    event = F.struct(
        F.concat(F.lit("evt_"), k.cast("string")).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_orderpriority").alias("activity"), F.col("o_orderstatus").alias("venue"),
        F.when(k % 9 != 0, F.format_string("%02d:00", (k % 24).cast("int"))).alias("start_time"),
        F.when(k % 14 != 0, F.format_string("%02d:30", (k % 24).cast("int"))).otherwise("").alias("end_time"))
    docs = o.groupBy(F.col("o_custkey").alias("library_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), event.alias("e")))), lambda s: s["e"]).alias("events"))
    doc = F.when(F.col("library_id") % 50 == 0, F.to_json(F.struct(F.lit("empty").alias("trip_name")))).otherwise(
        F.to_json(F.struct(F.concat(F.lit("Trip "), F.col("library_id").cast("string")).alias("trip_name"), "events")))
    return docs.select("library_id", doc.alias("body"))


@query("itinerary_events", """SELECT o_custkey AS library_id, concat('Trip ', o_custkey) AS trip_name,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS ord,
  concat('evt_', o_orderkey) AS event_id, strftime(o_orderdate, '%Y-%m-%d') AS date,
  CASE WHEN o_orderkey % 9 <> 0 THEN printf('%02d:00', o_orderkey % 24) END AS start_time
FROM orders WHERE o_custkey % 50 <> 0""")
def itinerary_events(spark: SparkSession, sf: str) -> DataFrame:
    return itineraries.itinerary_events(itinerary_docs(spark, sf)).select(
        "library_id", "trip_name", "ord", "event_id", "date", "start_time")


@query("itinerary_problems", """SELECT DISTINCT o_custkey AS library_id, CAST(NULL AS INT) AS ord, 'no event list' AS problem
FROM orders WHERE o_custkey % 50 = 0
UNION ALL
SELECT library_id, ord, 'missing field' FROM (
  SELECT o_custkey AS library_id, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS ord
  FROM orders WHERE o_custkey % 50 <> 0) WHERE o_orderkey % 9 = 0 OR o_orderkey % 14 = 0""")
def itinerary_problems(spark: SparkSession, sf: str) -> DataFrame:
    return itineraries.itinerary_problems(itinerary_docs(spark, sf))


# (start, end) of a day's events: an overlap, an empty instant, one that ends before it starts, one that runs past midnight.
WINDOWS = (("07:00", "09:30"), ("09:00", "12:00"), ("13:00", "13:00"), ("18:00", "17:00"), ("20:15", "23:59"), ("22:00", "25:10"))


def trip_events(spark: SparkSession, sf: str) -> DataFrame:
    """Five events on two days out of three, for every library and day that has photos."""
    days = views.photos(spark, sf).where("ts IS NOT NULL").select(
        "library_id", F.to_date("ts").alias("d")).distinct().where(F.dayofmonth("d") % 3 != 0)
    rows = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("start_time"), F.lit(e).alias("end_time"))
                     for n, (s, e) in enumerate(WINDOWS)])
    events = days.select("library_id", "d", F.inline(rows))
    date = F.date_format("d", "yyyy-MM-dd")
    return events.select(
        "library_id", F.concat(date, F.lit("_"), F.col("n").cast("string")).alias("event_id"), date.alias("date"),
        (F.datediff("d", F.lit("2024-01-01")) * 10 + F.col("n")).alias("ord"), "start_time", "end_time",
        F.concat(F.lit("act"), F.col("n").cast("string")).alias("activity"), F.lit("somewhere").alias("venue"))


V_MATCH = views.V_PHOTOS + f""",
v_trip AS (
  SELECT library_id, concat(d, '_', n) AS event_id, strftime(d, '%Y-%m-%d') AS date,
         CAST(date_diff('day', DATE '2024-01-01', d) * 10 + n AS INT) AS ord, concat('act', n) AS activity,
         d + to_minutes(CAST(left(s, 2) AS INT) * 60 + CAST(right(s, 2) AS INT)) AS t0,
         d + to_minutes(CAST(left(e, 2) AS INT) * 60 + CAST(right(e, 2) AS INT)) AS t1
  FROM (SELECT DISTINCT library_id, CAST(ts AS DATE) AS d FROM v_photos WHERE ts IS NOT NULL AND day(ts) % 3 <> 0)
  CROSS JOIN (VALUES {', '.join(f"({n}, '{s}', '{e}')" for n, (s, e) in enumerate(WINDOWS))}) w(n, s, e)),
v_match AS (
  SELECT p.library_id, p.photo_id, p.ordinal, p.ts, coalesce(arg_min(t.event_id, t.ord), 'other_moments') AS event_id
  FROM v_photos p LEFT JOIN v_trip t ON t.library_id = p.library_id AND p.ts BETWEEN t.t0 AND t.t1
  GROUP BY ALL),
v_matched AS (
  SELECT *, row_number() OVER (PARTITION BY library_id, event_id
              ORDER BY CASE WHEN event_id <> 'other_moments' THEN ts END NULLS FIRST, ordinal) - 1 AS pos,
         count(*) OVER (PARTITION BY library_id, event_id) AS photo_count
  FROM v_match)"""



def matched(spark: SparkSession, sf: str) -> DataFrame:
    """Matched photos, written once because the queries on top read them several times."""
    return cut_lineage(it.match_events(views.photos(spark, sf), trip_events(spark, sf)))


@query("photos_by_event", f"WITH {V_MATCH} SELECT library_id, photo_id, event_id FROM v_match")
def photos_by_event(spark: SparkSession, sf: str) -> DataFrame:
    found = it.match_events(views.photos(spark, sf), trip_events(spark, sf))
    return found.select("library_id", "photo_id", "event_id")


@query("event_chapters", f"""WITH {V_MATCH},
c AS (SELECT library_id, event_id, count(*) AS photo_count, max(CASE WHEN pos = photo_count // 2 THEN photo_id END) AS hero_photo_id
      FROM v_matched GROUP BY 1, 2)
SELECT t.library_id, t.event_id, t.activity, t.date, coalesce(c.photo_count, 0) AS photo_count, c.hero_photo_id
FROM v_trip t LEFT JOIN c ON c.library_id = t.library_id AND c.event_id = t.event_id
UNION ALL SELECT library_id, event_id, 'Other Moments', NULL, photo_count, hero_photo_id FROM c WHERE event_id = 'other_moments'""")
def event_chapters(spark: SparkSession, sf: str) -> DataFrame:
    placed = it.place_in_events(matched(spark, sf))
    return it.event_chapters(placed, trip_events(spark, sf)).select(
        "library_id", "event_id", "activity", "date", "photo_count", "hero_photo_id")


@query("other_moments", f"""WITH {V_MATCH}
SELECT library_id, photo_id, pos, photo_count FROM v_matched WHERE event_id = 'other_moments'""")
def other_moments(spark: SparkSession, sf: str) -> DataFrame:
    placed = it.place_in_events(matched(spark, sf))
    return placed.where(F.col("event_id") == it.OTHER).select("library_id", "photo_id", "pos", "photo_count")


ORDER_SQL = f"""{V_MATCH},
v_new AS (SELECT library_id, event_id, photo_id, photo_count - 1 - pos AS new_pos FROM v_matched
          WHERE library_id % 2 = 0 AND NOT (library_id = 4 AND pos = 0)),
v_ok AS (SELECT m.library_id, m.event_id FROM v_matched m LEFT JOIN v_new n
           ON n.library_id = m.library_id AND n.event_id = m.event_id AND n.photo_id = m.photo_id
         GROUP BY 1, 2 HAVING count(n.photo_id) = count(*))"""


def asked_order(placed: DataFrame) -> DataFrame:
    """Reversed chapters for half the libraries; one library forgets its first photos."""
    return placed.where("library_id % 2 = 0 AND NOT (library_id = 4 AND pos = 0)").select(
        "library_id", "event_id", "photo_id", (F.col("photo_count") - 1 - F.col("pos")).alias("new_pos"))


@query("valid_reorders", f"WITH {ORDER_SQL} SELECT library_id, event_id FROM v_ok")
def valid_reorders(spark: SparkSession, sf: str) -> DataFrame:
    placed = it.place_in_events(matched(spark, sf))
    return it.valid_reorders(placed, asked_order(placed))


@query("reordered_chapters", f"""WITH {ORDER_SQL}
SELECT m.library_id, m.event_id, m.photo_id, CASE WHEN o.event_id IS NULL THEN m.pos ELSE m.photo_count - 1 - m.pos END AS pos,
       CASE WHEN o.event_id IS NULL THEN m.pos ELSE m.photo_count - 1 - m.pos END = m.photo_count // 2 AS is_hero
FROM v_matched m LEFT JOIN v_ok o ON o.library_id = m.library_id AND o.event_id = m.event_id""")
def reordered_chapters(spark: SparkSession, sf: str) -> DataFrame:
    placed = it.place_in_events(matched(spark, sf))
    return it.reorder(placed, asked_order(placed)).select(
        "library_id", "event_id", "photo_id", "pos", (F.col("pos") == F.floor(F.col("photo_count") / 2)).alias("is_hero"))


@query("event_windows", f"WITH {V_MATCH} SELECT library_id, event_id, epoch(t0)::BIGINT AS start_s, epoch(t1)::BIGINT AS end_s FROM v_trip")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    seconds = lambda c: F.unix_seconds(it.window_start(F.col("date"), F.col(c)).cast("timestamp"))
    return trip_events(spark, sf).select(
        "library_id", "event_id", seconds("start_time").alias("start_s"), seconds("end_time").alias("end_s"))
