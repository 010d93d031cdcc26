"""Distances, places, titles, card layouts, frames and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.catalog import uploads as up
from albumforge.catalog import views
from albumforge.catalog.clustering import gap_placed
from albumforge.catalog.registry import query
from albumforge.functions import text as tx
from albumforge.functions.geo import haversine_km
from albumforge.operators import chapters as ch
from albumforge.operators import cluster as cl
from albumforge.operators import curation as cu
from albumforge.operators import documents as doc
from albumforge.operators import itinerary as it
from albumforge.operators import story as st
from albumforge.plans.stories import curated_story as curated
from albumforge.plans.stories import itinerary_story as along_itinerary
from albumforge.session import cut_lineage

# Day clusters: thirty-one chapters per library, thousands of photos each.
V_DAYS = views.V_PHOTOS + """,
v_day_no AS (
  SELECT library_id, day, CAST(row_number() OVER (PARTITION BY library_id ORDER BY day NULLS LAST) - 1 AS INT) AS cluster_idx
  FROM (SELECT DISTINCT library_id, CAST(ts AS DATE) AS day FROM v_photos)),
v_day_placed AS (
  SELECT p.*, d.cluster_idx, row_number() OVER (PARTITION BY p.library_id, d.cluster_idx ORDER BY p.ts, p.ordinal) - 1 AS pos,
         count(*) OVER (PARTITION BY p.library_id, d.cluster_idx) AS cluster_size
  FROM v_photos p JOIN v_day_no d ON p.library_id = d.library_id AND CAST(p.ts AS DATE) IS NOT DISTINCT FROM d.day),
v_day_chapters AS (
  SELECT library_id, cluster_idx, printf('chapter_%03d', cluster_idx + 1) AS chapter_id, count(*) AS photo_count,
         max(CASE WHEN pos = cluster_size // 2 THEN photo_id END) AS hero_photo_id, strftime(min(ts), '%Y-%m-%d') AS date,
         list_sort(list(lat) FILTER (lat IS NOT NULL))[count(lat) // 2 + 1] AS lat,
         list_sort(list(lng) FILTER (lng IS NOT NULL))[count(lng) // 2 + 1] AS lng
  FROM v_day_placed GROUP BY 1, 2)"""


def day_placed(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(cl.place_in_clusters(cl.day_clusters(views.photos(spark, sf))))


def day_chapters(placed: DataFrame) -> DataFrame:
    """The chapter table is small and read by everything after it."""
    return cut_lineage(ch.build_chapters(placed))


@query("chapters_by_day", f"""WITH {V_DAYS}
SELECT library_id, chapter_id, photo_count, hero_photo_id, date, round(lat, 6) AS lat, round(lng, 6) AS lng FROM v_day_chapters""")
def chapters_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return day_chapters(day_placed(spark, sf)).select(
        "library_id", "chapter_id", "photo_count", "hero_photo_id", "date",
        F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


KM = """2 * 6371 * asin(sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2)
        + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lng - {a}lng) / 2), 2)))"""
V_KM = V_DAYS + f""",
v_legs AS (SELECT library_id, cluster_idx, lat, lng, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM v_day_chapters
           WINDOW w AS (PARTITION BY library_id ORDER BY cluster_idx)),
v_km AS (SELECT library_id, CAST(floor(coalesce(sum({KM.format(a='p', b='')}), 0) + 0.5) AS BIGINT) AS distance_km FROM v_legs GROUP BY 1)"""


@query("haversine", f"""WITH {views.V_PHOTOS}
SELECT ordinal, round({KM.format(a='', b='x.')}, 6) AS km
FROM (SELECT *, {{'lat': 35.68e0, 'lng': 139.69e0}} AS x FROM v_photos WHERE lat IS NOT NULL)""")
def haversine(spark: SparkSession, sf: str) -> DataFrame:
    p = views.photos(spark, sf).where("lat IS NOT NULL")
    return p.select("ordinal", F.round(haversine_km(F.col("lat"), F.col("lng"), F.lit(35.68), F.lit(139.69)), 6).alias("km"))


@query("travelled_km", f"WITH {V_KM} SELECT library_id, distance_km FROM v_km")
def travelled_km(spark: SparkSession, sf: str) -> DataFrame:
    return st.travelled_km(day_chapters(day_placed(spark, sf)))


@query("headline_stats", """WITH s AS (SELECT o_orderkey AS k, o_orderkey % 90 AS km, o_orderkey * 7 % 4001 AS photos FROM orders)
SELECT k, CASE WHEN km >= 50 THEN 'distance' ELSE 'photo_count' END AS kind, CASE WHEN km >= 50 THEN km ELSE photos END AS raw,
       CASE WHEN km >= 50 THEN concat(format('{:,}', km), 'km travelled')
            WHEN photos = 1 THEN '1 photo taken' ELSE concat(format('{:,}', photos), ' photos taken') END AS value FROM s""")
def headline_stats(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return views.table(spark, sf, "orders").select(
        k.alias("k"), st.headline(k % 90, k * 7 % 4001).alias("h")).select("k", "h.*")


ADDRESS_SQL = """v_keys AS (SELECT DISTINCT printf('%.3f,%.3f', lat, lng) AS coord_key FROM v_day_chapters WHERE lat IS NOT NULL),
v_addr AS (SELECT coord_key, (length(coord_key) * 7 + ascii(substr(coord_key, 2, 1)) + ascii(right(coord_key, 1))) % 25 AS n FROM v_keys),
v_place AS (
  SELECT coord_key, CASE WHEN a.n % 5 = 0 THEN NULL ELSE n_name END AS country,
         CASE WHEN a.n % 5 = 0 THEN NULL WHEN a.n % 3 = 0 THEN concat('City ', a.n)
              WHEN a.n % 4 = 1 THEN n_name ELSE concat('Area ', a.n, ', City ', a.n) END AS label
  FROM v_addr a JOIN nation ON n_nationkey = a.n WHERE a.n % 7 <> 6)"""


def addresses(spark: SparkSession, sf: str, chapters: DataFrame) -> DataFrame:
    """Address parts for the wanted keys, made from nations; some keys have no answer."""
    key = F.col("coord_key")
    n = (F.length(key) * 7 + F.ascii(F.substring(key, 2, 1)) + F.ascii(F.right(key, F.lit(1)))) % 25
    keyed = st.wanted_keys(chapters).withColumn("n", n).where("n % 7 <> 6")
    named = keyed.join(views.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("n"))
    text = lambda word: F.concat(F.lit(word), F.col("n").cast("string"))
    none, five = F.lit(""), F.col("n") % 5 == 0
    city = F.when(five | ((F.col("n") % 4 == 1) & (F.col("n") % 3 != 0)), none).otherwise(text("City "))
    area = F.when(five, none).when(F.col("n") % 3 == 0, text("City ")).otherwise(text("Area "))
    return named.select("coord_key", area.alias("neighbourhood"), city.alias("city"),
                        F.when(five, none).otherwise(F.col("n_name")).alias("country"))


V_LOCATED = V_DAYS + ", " + ADDRESS_SQL + """,
v_located AS (SELECT c.*, p.label, p.country, p.coord_key IS NOT NULL AS has_location
              FROM v_day_chapters c LEFT JOIN v_place p ON printf('%.3f,%.3f', c.lat, c.lng) = p.coord_key),
v_named AS (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY cluster_idx) AS day_index FROM v_located)"""


def located(spark: SparkSession, sf: str, placed: DataFrame) -> DataFrame:
    chapters = day_chapters(placed)
    return st.locate_chapters(chapters, st.place_table(addresses(spark, sf, chapters)))


@query("located_chapters", f"""WITH {V_LOCATED}
SELECT library_id, chapter_id, label, country, has_location,
       CASE WHEN coalesce(label, '') = '' THEN concat('Day ', day_index) ELSE concat('Day ', day_index, ' — ', label) END AS title
FROM v_named""")
def located_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return st.name_chapters(located(spark, sf, day_placed(spark, sf))).select(
        "library_id", "chapter_id", "label", "country", "has_location", "title")


@query("main_country", f"""WITH {V_LOCATED},
n AS (SELECT library_id, country, count(*) AS c, min(cluster_idx) AS f FROM v_located WHERE country IS NOT NULL GROUP BY 1, 2)
SELECT library_id, country FROM (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY c DESC, f) AS rn FROM n) WHERE rn = 1""")
def main_country(spark: SparkSession, sf: str) -> DataFrame:
    return st.main_country(located(spark, sf, day_placed(spark, sf)))


@query("last_country", f"""WITH {V_LOCATED}
SELECT library_id, arg_max(country, cluster_idx) AS country FROM v_located WHERE country IS NOT NULL GROUP BY 1""")
def last_country(spark: SparkSession, sf: str) -> DataFrame:
    return st.last_country(located(spark, sf, day_placed(spark, sf)))


V_TWO = """v_div AS (SELECT library_id, cluster_idx, max(CASE WHEN rn = 1 THEN photo_id END) AS top_photo_id,
       coalesce(max(CASE WHEN rn = 2 THEN photo_id END), max(CASE WHEN rn = 1 THEN photo_id END)) AS bottom_photo_id
  FROM (SELECT *, row_number() OVER (PARTITION BY library_id, cluster_idx ORDER BY coalesce(quality, 0) DESC, pos) AS rn FROM {placed})
  GROUP BY 1, 2)"""
V_CARD = """v_side AS (
  SELECT p.*, c.hero_photo_id, row_number() OVER (PARTITION BY p.library_id, p.cluster_idx, p.orientation, p.photo_id = c.hero_photo_id
           ORDER BY coalesce(p.quality, 0) DESC, p.pos) AS rn
  FROM {placed} p JOIN {chapters} c ON c.library_id = p.library_id AND c.cluster_idx = p.cluster_idx),
v_pick AS (
  SELECT library_id, cluster_idx, max(CASE WHEN photo_id = hero_photo_id THEN photo_id END) AS h,
         max(CASE WHEN photo_id = hero_photo_id THEN orientation END) AS side,
         {picks}
  FROM v_side GROUP BY 1, 2),
v_card AS (
  SELECT library_id, cluster_idx,
         CASE WHEN side = 'portrait' AND p3 IS NOT NULL THEN 'portrait-4' WHEN side = 'landscape' AND l2 IS NOT NULL THEN 'landscape-3'
              WHEN side = 'portrait' AND p1 IS NOT NULL AND l1 IS NOT NULL THEN 'mixed-2p-1l'
              WHEN side = 'landscape' AND p2 IS NOT NULL THEN 'mixed-2p-1l'
              WHEN side = 'landscape' AND l1 IS NOT NULL THEN 'landscape-2' ELSE 'portrait-1' END AS layout,
         CASE WHEN side = 'portrait' AND p3 IS NOT NULL THEN concat_ws(',', h, p1, p2, p3)
              WHEN side = 'landscape' AND l2 IS NOT NULL THEN concat_ws(',', h, l1, l2)
              WHEN side = 'portrait' AND p1 IS NOT NULL AND l1 IS NOT NULL THEN concat_ws(',', h, p1, l1)
              WHEN side = 'landscape' AND p2 IS NOT NULL THEN concat_ws(',', p1, p2, h)
              WHEN side = 'landscape' AND l1 IS NOT NULL THEN concat_ws(',', h, l1) ELSE h END AS photo_ids
  FROM v_pick)"""
PICKS = ", ".join(f"max(CASE WHEN photo_id <> hero_photo_id AND orientation = '{o}' AND rn = {n} THEN photo_id END) AS {o[0]}{n}"
                  for o in ("portrait", "landscape") for n in (1, 2, 3))


@query("divider_photos", f"""WITH {views.V_GAPS}, {V_TWO.format(placed='v_placed')}
SELECT library_id, cluster_idx, top_photo_id, bottom_photo_id FROM v_div""")
def divider_photos(spark: SparkSession, sf: str) -> DataFrame:
    return st.divider_photos(gap_placed(spark, sf))


@query("card_layouts", f"""WITH {views.V_CHAPTERS}, {V_CARD.format(placed='v_placed', chapters='v_chapters', picks=PICKS)}
SELECT library_id, cluster_idx, layout, photo_ids FROM v_card""")
def card_layouts(spark: SparkSession, sf: str) -> DataFrame:
    placed = gap_placed(spark, sf)
    return st.card_layouts(placed, ch.select_heroes(placed)).select(
        "library_id", "cluster_idx", "layout", F.array_join("photo_ids", ",").alias("photo_ids"))


V_FRAMES = V_LOCATED + ", " + V_TWO.format(placed="v_day_placed") + ", " + V_CARD.format(
    placed="v_day_placed", chapters="v_day_chapters", picks=PICKS) + """,
v_title AS (SELECT *, CASE WHEN coalesce(label, '') = '' THEN concat('Day ', day_index) ELSE concat('Day ', day_index, ' — ', label) END AS title FROM v_named),
v_frames AS (
  SELECT DISTINCT library_id, 0 AS frame_no, 'frame_cover' AS frame_id, 'cover' AS type, NULL AS chapter_id, NULL AS title,
         NULL AS top_photo_id, NULL AS bottom_photo_id, NULL AS layout, NULL AS photo_ids, NULL AS text FROM v_title
  UNION ALL
  SELECT t.library_id, 2 * day_index - 1, concat('frame_divider_', chapter_id), 'chapterDivider', chapter_id, title,
         d.top_photo_id, d.bottom_photo_id, NULL, NULL, NULL
  FROM v_title t JOIN v_div d ON d.library_id = t.library_id AND d.cluster_idx = t.cluster_idx
  UNION ALL
  SELECT t.library_id, 2 * day_index, concat('frame_photocard_', chapter_id), 'photoCard', chapter_id, NULL, NULL, NULL,
         c.layout, c.photo_ids, NULL
  FROM v_title t JOIN v_card c ON c.library_id = t.library_id AND c.cluster_idx = t.cluster_idx
  UNION ALL
  SELECT library_id, 2 * max(day_index) + 1, 'frame_coda', 'coda', NULL, NULL, NULL, NULL, NULL, NULL, 'The end.' FROM v_title GROUP BY 1)"""


def story_frames(spark: SparkSession, sf: str) -> DataFrame:
    placed = day_placed(spark, sf)
    named = st.name_chapters(located(spark, sf, placed))
    stories = named.groupBy("library_id").agg(F.sum("photo_count").alias("n")).select(
        "library_id", F.lit(None).cast("string").alias("trip_name"), F.format_number("n", 0).alias("stat"))
    return st.frames(named, st.divider_photos(placed), st.card_layouts(placed, named), stories)


@query("story_frames", f"""WITH {V_FRAMES}
SELECT library_id, CAST(frame_no AS INT) AS frame_no, frame_id, type, chapter_id, title, top_photo_id, bottom_photo_id, layout, photo_ids, text FROM v_frames""")
def story_frames_query(spark: SparkSession, sf: str) -> DataFrame:
    return story_frames(spark, sf).select(
        "library_id", "frame_no", "frame_id", "type", "chapter_id", "title", "top_photo_id", "bottom_photo_id",
        "layout", F.array_join("photo_ids", ",").alias("photo_ids"), "text")


@query("frame_starts", f"""WITH {V_FRAMES}
SELECT library_id, CAST(frame_no AS INT) AS frame_no, CASE WHEN frame_no > 0 THEN 2000 * (frame_no - 1) END AS start_ms FROM v_frames""")
def frame_starts(spark: SparkSession, sf: str) -> DataFrame:
    return st.frame_starts(story_frames(spark, sf)).select("library_id", "frame_no", "start_ms")


V_TRIP_DATES = """r AS (SELECT c_custkey, c_name, c_custkey % 400 AS d, c_custkey % 45 AS len, c_custkey % 7 AS m FROM customer),
d AS (SELECT *, CASE WHEN m > 0 THEN DATE '2024-01-15' + CAST(d AS INT) END AS s,
             CASE WHEN m > 0 THEN DATE '2024-01-15' + CAST(d + len AS INT) END AS e,
             CASE WHEN c_custkey % 3 = 0 THEN 'Italy' WHEN c_custkey % 3 = 1 THEN '' END AS country FROM r)"""


def trip_dates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    day = lambda n: F.when(k % 7 > 0, F.date_add(F.lit("2024-01-15").cast("date"), n.cast("int")))
    return views.table(spark, sf, "customer").select(
        k, day(k % 400).alias("s"), day(k % 400 + k % 45).alias("e"),
        F.when(k % 3 == 0, "Italy").when(k % 3 == 1, "").alias("country"))


@query("trip_names", f"""WITH {V_TRIP_DATES},
l AS (SELECT *, concat(CASE WHEN monthname(s) = monthname(e) THEN monthname(s) ELSE concat(monthname(s), '–', monthname(e)) END, ' ', year(e)) AS label FROM d)
SELECT c_custkey, CASE WHEN s IS NULL THEN coalesce(nullif(country, ''), 'Your Story')
                       WHEN coalesce(country, '') = '' THEN label ELSE concat(country, ', ', label) END AS trip_name,
       CASE WHEN s IS NULL THEN 'Undated'
            WHEN month(s) = month(e) AND year(s) = year(e) THEN concat(monthname(s), ' ', day(s), '–', day(e), ', ', year(e))
            ELSE concat(monthname(s), ' ', day(s), ' – ', monthname(e), ' ', day(e), ', ', year(e)) END AS date_label FROM l""")
def trip_names(spark: SparkSession, sf: str) -> DataFrame:
    s, e = F.col("s"), F.col("e")
    return trip_dates(spark, sf).select(
        "c_custkey", tx.trip_name(s, e, F.col("country")).alias("trip_name"), tx.date_range_label(s, e).alias("date_label"))


@query("trip_titles", """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 AND c_custkey % 4 = 0 THEN c_name END,
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 5 = 0 THEN 'Peru' END, 'trip') AS title FROM customer""")
def trip_titles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    survey = F.when(k % 4 == 0, F.col("c_name")).when(k % 2 == 0, "")
    return views.table(spark, sf, "customer").select(k, st.trip_title(
        survey, F.when(k % 3 == 0, F.col("c_mktsegment")), F.when(k % 5 == 0, "Peru")).alias("title"))


@query("chapter_headings", """WITH t AS (SELECT n_nationkey, n_name, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN concat('Day ', c_custkey % 12 + 1) WHEN c_custkey % 4 = 3 THEN 'Arrival' ELSE n_name END AS heading FROM t""")
def chapter_headings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    named = views.table(spark, sf, "customer").join(
        views.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    day = (k % 12 + 1).cast("int")
    title = F.when(k % 4 == 3, F.lit("Arrival")).otherwise(
        tx.chapter_title(day, F.when(k % 4 != 0, F.col("n_name"))))
    return named.select(k, tx.strip_day_prefix(title, day).alias("heading"))


def kept_photos(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("ordinal")
    return views.photos(spark, sf).where(i % 4 != 1).withColumns({
        "thumbnail_hero_url": F.when(i % 5 == 2, F.lit("data:image/jpeg;base64,aGVybw==")),
        "thumbnail_url": F.when(i % 5 == 3, F.lit("data:image/jpeg;base64,c21hbGw=")),
        "name": F.when(i % 9 == 0, F.lit("")).when(i % 9 == 1, F.lit("--a b.c.PNG")).otherwise(F.col("name"))})


def originals(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("ordinal")
    return views.photos(spark, sf).where(i % 5 == 1).select(
        "library_id", "photo_id", F.concat(F.lit("Orig "), i.cast("string"), F.when(i % 2 == 0, ".HEIC").otherwise("")).alias("original_name"))


@query("export_manifest", f"""WITH {views.V_PHOTOS},
k AS (SELECT *, CASE WHEN ordinal % 9 = 0 THEN '' WHEN ordinal % 9 = 1 THEN '--a b.c.PNG' ELSE name END AS nm,
             ordinal % 5 = 1 AS orig FROM v_photos WHERE ordinal % 4 <> 1 AND ordinal % 5 IN (1, 2, 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY coalesce((epoch_us(ts) // 1000), 0), ordinal) AS number FROM k)
SELECT library_id, photo_id, number, concat(CASE WHEN number < 10 THEN '0' ELSE '' END, number, '-',
         CASE WHEN nm = '' AND orig THEN concat('Orig-', ordinal) WHEN nm = '' THEN 'photo' WHEN nm LIKE '--a%' THEN 'a-b-c' ELSE concat('IMG_', ordinal) END,
         CASE WHEN orig AND ordinal % 2 = 0 THEN '.heic' ELSE '.jpg' END) AS file_name,
       CASE WHEN orig THEN 'original' WHEN ordinal % 5 = 2 THEN 'hero_thumbnail' ELSE 'thumbnail' END AS source FROM n""")
def export_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return doc.export_manifest(kept_photos(spark, sf), originals(spark, sf))


@query("downloadable_photos", f"WITH {views.V_PHOTOS} SELECT library_id, photo_id FROM v_photos WHERE ordinal % 4 <> 1 AND ordinal % 5 IN (1, 2, 3)")
def downloadable_photos(spark: SparkSession, sf: str) -> DataFrame:
    return doc.downloadable(kept_photos(spark, sf), originals(spark, sf)).select("library_id", "photo_id")


@query("kept_in_time_order", f"""WITH {views.V_PHOTOS}
SELECT library_id, photo_id, row_number() OVER (PARTITION BY library_id ORDER BY coalesce((epoch_us(ts) // 1000), 0), ordinal) - 1 AS kept_no
FROM v_photos WHERE ordinal % 4 <> 1""")
def kept_in_time_order(spark: SparkSession, sf: str) -> DataFrame:
    return cu.kept_in_time_order(views.photos(spark, sf).where("ordinal % 4 <> 1")).select("library_id", "photo_id", "kept_no")


@query("story_rows", f"""WITH {up.V_MATCH}
SELECT t.library_id, concat('Trip ', t.library_id) AS trip_name, t.event_id, t.activity, m.photo_id, m.pos
FROM v_trip t LEFT JOIN v_matched m ON m.library_id = t.library_id AND m.event_id = t.event_id
UNION ALL SELECT library_id, concat('Trip ', library_id), event_id, 'Other Moments', photo_id, pos FROM v_matched WHERE event_id = 'other_moments'""")
def story_rows(spark: SparkSession, sf: str) -> DataFrame:
    events = up.trip_events(spark, sf)
    placed = it.place_in_events(up.matched(spark, sf))
    trips = events.select("library_id", F.concat(F.lit("Trip "), F.col("library_id").cast("string")).alias("trip_name")).distinct()
    return doc.story_rows(placed, it.event_chapters(placed, events), trips).select(
        "library_id", "trip_name", "event_id", "activity", "photo_id", "pos")


# Of every library, each third photo is kept, but of library 4 none.
KEPT = "ordinal % 3 = 0 AND library_id <> 4"
V_CURATED = V_LOCATED + f""",
v_cur_placed AS (SELECT * FROM v_day_placed WHERE {KEPT}),
v_cur_chapters AS (
  SELECT l.library_id, l.cluster_idx, l.chapter_id, l.lat, l.lng, l.label, count(*) AS photo_count,
         coalesce(max(CASE WHEN k.photo_id = l.hero_photo_id THEN k.photo_id END), arg_min(k.photo_id, k.pos)) AS hero_photo_id
  FROM v_located l JOIN v_cur_placed k ON k.library_id = l.library_id AND k.cluster_idx = l.cluster_idx GROUP BY ALL),
v_cur_title AS (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY cluster_idx) AS day_index,
  concat('Day ', row_number() OVER (PARTITION BY library_id ORDER BY cluster_idx), CASE WHEN coalesce(label, '') = '' THEN '' ELSE concat(' — ', label) END) AS title FROM v_cur_chapters),
{V_TWO.format(placed="v_cur_placed")}, {V_CARD.format(placed="v_cur_placed", chapters="v_cur_chapters", picks=PICKS)},
v_cur_legs AS (SELECT library_id, lat, lng, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM v_cur_chapters WINDOW w AS (PARTITION BY library_id ORDER BY cluster_idx)),
v_cur_km AS (SELECT library_id, CAST(floor(coalesce(sum({KM.format(a='p', b='')}), 0) + 0.5) AS BIGINT) AS km FROM v_cur_legs GROUP BY 1),
v_cur_land AS (SELECT library_id, arg_max(country, cluster_idx) AS country FROM v_located WHERE country IS NOT NULL GROUP BY 1),
v_cur_trip AS (SELECT library_id, min(ts) AS s, max(ts) AS e, count(*) AS photos FROM v_photos GROUP BY 1),
v_cover AS (
  SELECT k.library_id, concat(CASE WHEN coalesce(country, '') = '' THEN '' ELSE concat(country, ', ') END,
           CASE WHEN monthname(s) = monthname(e) THEN monthname(s) ELSE concat(monthname(s), '–', monthname(e)) END, ' ', year(e)) AS trip_name,
         CASE WHEN km >= 50 THEN concat(format('{{:,}}', km), 'km travelled') ELSE concat(format('{{:,}}', photos), ' photos taken') END AS stat
  FROM v_cur_km k JOIN v_cur_trip t ON t.library_id = k.library_id LEFT JOIN v_cur_land l ON l.library_id = k.library_id)"""


@query("curated_story", f"""WITH {V_CURATED}, f AS (
  SELECT library_id, 0 AS frame_no, 'cover' AS type, NULL AS chapter_id, trip_name AS title, stat AS detail FROM v_cover
  UNION ALL SELECT t.library_id, 2 * day_index - 1, 'chapterDivider', chapter_id, title, concat(d.top_photo_id, ',', d.bottom_photo_id)
  FROM v_cur_title t JOIN v_div d ON d.library_id = t.library_id AND d.cluster_idx = t.cluster_idx
  UNION ALL SELECT t.library_id, 2 * day_index, 'photoCard', chapter_id, c.layout, c.photo_ids
  FROM v_cur_title t JOIN v_card c ON c.library_id = t.library_id AND c.cluster_idx = t.cluster_idx
  UNION ALL SELECT library_id, 2 * max(day_index) + 1, 'coda', NULL, NULL, 'The end.' FROM v_cur_title GROUP BY 1)
SELECT library_id, CAST(frame_no AS INT) AS frame_no, type, chapter_id, title, detail, CASE WHEN frame_no > 0 THEN 2000 * (frame_no - 1) END AS start_ms FROM f""")
def curated_story(spark: SparkSession, sf: str) -> DataFrame:
    placed = day_placed(spark, sf)
    meta = views.photos(spark, sf).groupBy("library_id").agg(
        F.count("*").alias("photos"), F.to_date(F.min("ts")).alias("start_date"), F.to_date(F.max("ts")).alias("end_date"))
    made = curated(located(spark, sf, placed), placed, placed.where(KEPT), meta)
    return made.frames.select(
        "library_id", "frame_no", "type", "chapter_id", F.coalesce("trip_name", "title", "layout").alias("title"),
        F.coalesce("stat", F.when(F.col("type") == "chapterDivider", F.concat_ws(",", "top_photo_id", "bottom_photo_id")),
                   F.array_join("photo_ids", ","), "text").alias("detail"), "start_ms")


@query("itinerary_story", f"""WITH {up.V_MATCH},
m AS (SELECT library_id, event_id, photo_id, photo_count, CASE WHEN event_id LIKE '%\\_1' ESCAPE '\\' THEN photo_count - 1 - pos ELSE pos END AS pos FROM v_matched),
c AS (SELECT library_id, event_id, count(*) AS photo_count, max(CASE WHEN pos = photo_count // 2 THEN photo_id END) AS hero_photo_id FROM m GROUP BY 1, 2)
SELECT t.library_id, concat('Trip ', t.library_id) AS trip_name, t.event_id, t.activity, coalesce(c.photo_count, 0) AS photo_count, c.hero_photo_id, m.photo_id, m.pos
FROM v_trip t LEFT JOIN c ON c.library_id = t.library_id AND c.event_id = t.event_id LEFT JOIN m ON m.library_id = t.library_id AND m.event_id = t.event_id
UNION ALL SELECT m.library_id, concat('Trip ', m.library_id), m.event_id, 'Other Moments', c.photo_count, c.hero_photo_id, m.photo_id, m.pos
FROM m JOIN c ON c.library_id = m.library_id AND c.event_id = m.event_id WHERE m.event_id = 'other_moments'""")
def itinerary_story(spark: SparkSession, sf: str) -> DataFrame:
    """The second event of each day is asked for in reverse order."""
    photos, events = views.photos(spark, sf), up.trip_events(spark, sf)
    trips = events.select("library_id", F.concat(F.lit("Trip "), F.col("library_id").cast("string")).alias("trip_name")).distinct()
    as_matched = it.place_in_events(up.matched(spark, sf)).where("event_id LIKE '%\\_1'")
    order = as_matched.select("library_id", "event_id", "photo_id", (F.col("photo_count") - 1 - F.col("pos")).alias("new_pos"))
    _, rows = along_itinerary(photos, events, trips, order)
    return rows.select(
        "library_id", "trip_name", "event_id", "activity", "photo_count", "hero_photo_id", "photo_id", "pos")
