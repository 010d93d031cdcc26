"""Per-row rules: scores, sizes, names, keys, time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.catalog import views
from albumforge.catalog.registry import query
from albumforge.functions import pixels as px
from albumforge.functions import scores as sc
from albumforge.functions import text as tx
from albumforge.functions.geo import coordinate_key
from albumforge.operators.ordering import with_positions
from albumforge.sources.scored import parse_reply

# A name as numbers: punctuation by its place in the order, then digit runs by value, then other characters by code.
NAME_SQL = """list_transform(regexp_extract_all(lower({name}), '[0-9]+|[^0-9]'), lambda t:
  CASE WHEN t[1] BETWEEN '0' AND '9' THEN (1::BIGINT << 60) + CAST(t AS BIGINT) WHEN strpos('{order}', t) > 0 THEN strpos('{order}', t) ELSE (2::BIGINT << 60) + ord(t) END)"""


@query("natural_name_order", f"""WITH k AS (SELECT page_id, {NAME_SQL.format(name='url', order=tx.PUNCTUATION_ORDER.replace("'", "''"))} AS parts FROM pages)
SELECT page_id, row_number() OVER (ORDER BY parts, page_id) - 1 AS pos FROM k""")
def natural_name_order(spark: SparkSession, sf: str) -> DataFrame:
    p = views.table(spark, sf, "pages").select("page_id", tx.natural_key(F.col("url")).alias("key"))
    return with_positions(p, [], [F.col("key").asc(), F.col("page_id").asc()]).select("page_id", "pos")


@query("time_then_name_order", f"""WITH {views.V_PHOTOS}
SELECT library_id, photo_id, row_number() OVER (PARTITION BY library_id ORDER BY date_trunc('day', ts) NULLS LAST, length(name), name) - 1 AS pos FROM v_photos""")
def time_then_name_order(spark: SparkSession, sf: str) -> DataFrame:
    p = views.photos(spark, sf).select("library_id", "photo_id", "ordinal", F.date_trunc("day", "ts").alias("day"),
                                       tx.natural_key(F.col("name")).alias("key"))
    return with_positions(p, ["library_id"], [F.col("day").asc_nulls_last(), F.col("key").asc(), F.col("ordinal").asc()]
                          ).select("library_id", "photo_id", "pos")


@query("dated_and_located", f"WITH {views.V_PHOTOS} SELECT library_id, ts IS NULL AS undated, lat IS NULL AS unlocated, count(*) AS n FROM v_photos GROUP BY 1, 2, 3")
def dated_and_located(spark: SparkSession, sf: str) -> DataFrame:
    return views.photos(spark, sf).groupBy(
        "library_id", F.col("ts").isNull().alias("undated"), F.col("lat").isNull().alias("unlocated")).agg(F.count("*").alias("n"))


SIZE_SQL = """s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 17 > 0 THEN p_partkey * 37 % 5000 + 1 END AS w, p_partkey * 53 % 4000 + 1 AS h,
  CASE p_partkey % 4 WHEN 0 THEN 'portrait' WHEN 1 THEN 'landscape' WHEN 2 THEN '6' END AS o FROM part)"""


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return views.table(spark, sf, "part").select(
        k.alias("k"), F.when(k % 17 > 0, k * 37 % 5000 + 1).alias("w"), (k * 53 % 4000 + 1).alias("h"),
        F.when(k % 4 == 0, "portrait").when(k % 4 == 1, "landscape").when(k % 4 == 2, "6").alias("o"))


@query("display_orientation", f"""WITH {SIZE_SQL}
SELECT k, CASE WHEN o IN ('portrait', 'landscape') THEN o WHEN w IS NULL THEN NULL WHEN h > w THEN 'portrait' ELSE 'landscape' END AS side FROM s""")
def display_orientation(spark: SparkSession, sf: str) -> DataFrame:
    return sizes(spark, sf).select("k", sc.display_orientation(F.col("o"), F.col("w"), F.col("h")).alias("side"))


@query("fitted_sizes", f"""WITH {SIZE_SQL}
SELECT k, CAST(CASE WHEN w > h AND w > 1000 THEN 1000 WHEN w <= h AND h > 1000 THEN floor(w * 1000 / h::DOUBLE + 0.5) ELSE w END AS BIGINT) AS fit_w,
       CAST(CASE WHEN w <= h AND h > 1000 THEN 1000 WHEN w > h AND w > 1000 THEN floor(h * 1000 / w::DOUBLE + 0.5) ELSE h END AS BIGINT) AS fit_h,
       CASE WHEN w IS NOT NULL THEN CAST(greatest(1, floor(w * (512 / greatest(w, h)::DOUBLE) + 0.5)) AS BIGINT) END AS send_w,
       CASE WHEN w IS NOT NULL THEN CAST(greatest(1, floor(h * (512 / greatest(w, h)::DOUBLE) + 0.5)) AS BIGINT) END AS send_h FROM s""")
def fitted_sizes(spark: SparkSession, sf: str) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    both = sizes(spark, sf).select("k", sc.fit_box(w, h, 1000).alias("f"), sc.scale_long_edge(w, h, 512).alias("s"))
    return both.select("k", F.col("f.width").alias("fit_w"), F.col("f.height").alias("fit_h"),
                       F.col("s.width").alias("send_w"), F.col("s.height").alias("send_h"))


@query("score_rules", """WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_extendedprice / 300 - 60 AS v, l_discount * 12 - 0.1 AS x, CAST(l_quantity AS INT) AS q, l_linenumber AS n FROM lineitem)
SELECT k, floor(1000 / (1 + exp(-0.01e0 * (v - 200))) + 0.5e0) / 1000 AS sharpness, CAST(least(3, greatest(0, floor(x * 4))) AS INT) AS bucket,
       round(least(1.0e0, greatest(0.0e0, x)), 6) AS clamped,
       CASE WHEN q - 1 = 0 THEN 'empty' WHEN q - 1 < n * 5 THEN 'under' WHEN q - 1 <= ceil(n * 5 * 115 / 100.0e0) THEN 'on' ELSE 'over' END AS zone,
       CAST(least(8, greatest(1, floor(q * 0.2e0 + 0.5e0))) AS BIGINT) AS fallback,
       CASE WHEN n % 2 = 0 AND n % 3 = 0 THEN 1.0e0 WHEN n % 2 = 0 THEN 0.6e0 ELSE 0.2e0 END AS coverage,
       CASE WHEN n % 2 = 0 AND n % 3 = 0 THEN 'green' WHEN n % 2 = 0 THEN 'amber' ELSE 'red' END AS band FROM s""")
def score_rules(spark: SparkSession, sf: str) -> DataFrame:
    l = views.table(spark, sf, "lineitem")
    v, x = F.col("l_extendedprice") / 300 - 60, F.col("l_discount") * 12 - F.lit(0.1)
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    cover = sc.exposure_coverage(n % 2 == 0, n % 3 == 0)
    return l.select(
        (F.col("l_orderkey") * 10 + n).alias("k"), sc.sharpness_score(v).alias("sharpness"), sc.quartile_bucket(x).alias("bucket"),
        F.round(sc.unit_clamp(x), 6).alias("clamped"), sc.progress_zone(q - 1, n * 5).alias("zone"),
        sc.fallback_target(q).alias("fallback"), cover.alias("coverage"), sc.light_band(cover).alias("band"))


@query("laplacian_variance", f"""WITH {views.V_EMB},
g AS (SELECT photo_id, list_transform(blocks, lambda x: x * 255) AS b FROM v_emb),
l AS (SELECT photo_id, list_transform(range(36), lambda c: b[(c // 6 + 0) * 8 + c % 6 + 2] + b[(c // 6 + 2) * 8 + c % 6 + 2]
       + b[(c // 6 + 1) * 8 + c % 6 + 1] + b[(c // 6 + 1) * 8 + c % 6 + 3] - 4 * b[(c // 6 + 1) * 8 + c % 6 + 2]) AS laps FROM g)
SELECT photo_id, round(list_var_pop(laps), 4) AS variance FROM l""")
def laplacian_variance(spark: SparkSession, sf: str) -> DataFrame:
    gray = F.transform("blocks", lambda x: x.cast("double") * 255)
    side = F.lit(8)
    return views.vectors(spark, sf).select("photo_id", gray.alias("g")).select(
        "photo_id", F.round(px.laplacian_variance(F.col("g"), side, side), 4).alias("variance"))


@query("laplacian_variance_vectorised", f"""WITH {views.V_EMB},
g AS (SELECT photo_id, list_transform(blocks, lambda x: x * 255) AS b FROM v_emb),
l AS (SELECT photo_id, list_transform(range(36), lambda c: b[(c // 6 + 0) * 8 + c % 6 + 2] + b[(c // 6 + 2) * 8 + c % 6 + 2]
       + b[(c // 6 + 1) * 8 + c % 6 + 1] + b[(c // 6 + 1) * 8 + c % 6 + 3] - 4 * b[(c // 6 + 1) * 8 + c % 6 + 2]) AS laps FROM g)
SELECT photo_id, round(list_var_pop(laps), 4) AS variance FROM l""")
def laplacian_variance_vectorised(spark: SparkSession, sf: str) -> DataFrame:
    gray = F.transform("blocks", lambda x: x.cast("double") * 255)
    return views.vectors(spark, sf).select(
        "photo_id", F.round(px.laplacian_variance_np(gray, F.lit(8), F.lit(8)), 4).alias("variance"))


@query("export_names", r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN '!!!' WHEN page_id % 10 = 1 THEN concat(url, '.TiFF') ELSE url END AS n FROM pages),
b AS (SELECT *, trim(regexp_replace(regexp_replace(n, '\.[^.]+$', ''), '[^a-zA-Z0-9_-]+', '-', 'g'), '-') AS base, regexp_extract(n, '\.([a-zA-Z0-9]+)$', 1) AS ext FROM p)
SELECT page_id, CASE WHEN base = '' THEN 'photo' ELSE base END AS base, CASE WHEN ext = '' THEN '.jpg' ELSE concat('.', lower(ext)) END AS ext,
       CASE WHEN page_id < 10 THEN concat('0', page_id) ELSE CAST(page_id AS VARCHAR) END AS prefix FROM b""")
def export_names(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    name = F.when(i % 10 == 0, "!!!").when(i % 10 == 1, F.concat("url", F.lit(".TiFF"))).otherwise(F.col("url"))
    return views.table(spark, sf, "pages").select(
        i, tx.clean_base(name).alias("base"), tx.extension(name).alias("ext"), tx.padded(i, 2).alias("prefix"))


@query("coordinate_keys", f"WITH {views.V_PHOTOS} SELECT photo_id, printf('%.3f,%.3f', lat, lng) AS coord_key FROM v_photos WHERE lat IS NOT NULL")
def coordinate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return views.photos(spark, sf).where("lat IS NOT NULL").select("photo_id", coordinate_key(F.col("lat"), F.col("lng")).alias("coord_key"))


@query("data_urls", "SELECT item_id, text FROM benchmark")
def data_urls(spark: SparkSession, sf: str) -> DataFrame:
    b = views.table(spark, sf, "benchmark")
    url = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")))
    return b.select("item_id", F.decode(tx.data_url_bytes(url), "UTF-8").alias("text"))


@query("model_replies", """WITH e AS (SELECT event_id AS i, event_id % 8 AS f, event_id % 150 AS n FROM events)
SELECT i, CASE WHEN f IN (3, 4, 7) THEN NULL ELSE round(CASE f WHEN 5 THEN 1.0e0 WHEN 6 THEN 0.0e0 ELSE n / 200.0e0 END, 6) END AS score,
       CASE WHEN f IN (0, 1) THEN n % 2 = 0 END AS keep,
       CASE WHEN f IN (3, 4, 7) THEN NULL WHEN f IN (0, 1) THEN repeat('r', least(n, 80)::INT) ELSE '' END AS reason FROM e""")
def model_replies(spark: SparkSession, sf: str) -> DataFrame:
    i, f, n = F.col("event_id"), F.col("event_id") % 8, F.col("event_id") % 150
    number = F.format_string("%.3f", n / 200.0)
    full = F.concat(F.lit('{"score": '), number, F.lit(', "keep": '), (n % 2 == 0).cast("string"), F.lit(', "reason": "'),
                    F.repeat(F.lit("r"), n), F.lit('"}'))
    reply = (
        F.when(f == 0, full).when(f == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(f == 2, F.concat(F.lit(' {"score": '), number, F.lit(', "keep": "yes", "reason": 7}')))
        .when(f == 3, F.lit("sorry, no")).when(f == 4, F.lit('{"score": "0.5"}'))
        .when(f == 5, F.lit('{"score": 7}')).when(f == 6, F.lit('{"score": -1}')).otherwise(F.lit("")))
    return views.events(spark, sf).select(i.alias("i"), parse_reply(reply).alias("r")).select(
        "i", F.round("r.score", 6).alias("score"), "r.keep", "r.reason")


@query("local_clock", f"""WITH {views.V_PHOTOS} SELECT photo_id, coalesce(strftime(ts + INTERVAL 330 MINUTE, '%H:%M'), '') AS clock, coalesce((epoch_us(ts) // 1000), 0) AS ms FROM v_photos""")
def local_clock(spark: SparkSession, sf: str) -> DataFrame:
    from albumforge.functions.times import epoch_ms
    from albumforge.functions.times import local_clock as clock

    return views.photos(spark, sf).select("photo_id", clock(F.col("ts"), "Asia/Kolkata").alias("clock"), epoch_ms(F.col("ts")).alias("ms"))


@query("duplicate_view_scores", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.0e0 WHEN 2 THEN greatest(0.0e0, 1 - (event_id % 30) / 20.0e0) ELSE 0.5e0 END AS score FROM events""")
def duplicate_view_scores(spark: SparkSession, sf: str) -> DataFrame:
    from albumforge.operators.snapshots import by_score

    i = F.col("event_id")
    status = F.when(i % 4 == 0, "kept").when(i % 4 == 1, "exact").otherwise("burst")
    scored = views.events(spark, sf).select("event_id", sc.dedup_view_score(status, F.when(i % 4 == 2, i % 30)).alias("score"))
    return by_score(scored, F.col("score"))
