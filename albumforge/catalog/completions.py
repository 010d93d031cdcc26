"""Events of finished curations, and the daily metrics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.catalog import usage_metrics, views
from albumforge.catalog.choosing import CELL
from albumforge.catalog.registry import query
from albumforge.operators import metrics as m
from albumforge.operators import selection as sel
from albumforge.operators.completion import completion_events as emitted

_CELLS = [f"{c}_q{i}" for c in sel.CELLS for i in range(4)]

V_SESS = f"""{views.V_CONF},
v_sess AS (
  SELECT concat('src', user_id % 20) AS library_id, concat('s', user_id) AS session_id, min(ts) AS done
  FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
v_open AS (SELECT concat('s', user_id) AS session_id, min(ts) AS opened FROM events WHERE event_type = 'signup' GROUP BY 1)"""

# All presses of the library.
V_PRESS = """v_click AS (SELECT concat('src', user_id % 20) AS library_id, event_id % 50 AS photo_id FROM events WHERE event_type = 'click'),
v_press AS (SELECT s.library_id, s.session_id, count(*) AS presses, count(DISTINCT photo_id) AS photos FROM v_sess s JOIN v_click c ON c.library_id = s.library_id GROUP BY 1, 2)"""


def done_sql(press: str) -> str:
    """The completion events as CTEs, given how v_press (library_id, session_id, presses, photos) is made."""
    return f"""{V_SESS}, {press},
v_bucket AS (SELECT library_id, quality, {CELL} AS cell,
             CASE WHEN quality IS NOT NULL THEN CAST(least(3, greatest(0, floor(quality * 4))) AS INT) END AS b, auto, kept FROM v_conf),
v_lib AS (SELECT library_id, count(*) AS uploaded, count(*) FILTER (auto) AS auto_kept, count(*) FILTER (kept) AS user_kept,
          count(*) FILTER (quality IS NULL) AS null_quality,
          {', '.join(f"count(*) FILTER (cell = '{c}' AND b = {i}) AS {c}_q{i}" for c in sel.CELLS for i in range(4))} FROM v_bucket GROUP BY 1),
v_all AS (SELECT s.*, o.opened, p.presses, p.photos, l.* EXCLUDE (library_id) FROM v_sess s LEFT JOIN v_open o ON o.session_id = s.session_id
          LEFT JOIN v_press p ON p.library_id = s.library_id AND p.session_id = s.session_id LEFT JOIN v_lib l ON l.library_id = s.library_id),
v_events AS (
  SELECT library_id, session_id, done AS server_ts, '{m.CURATION_DURATION}' AS event_name, concat('{{"ms":', CAST(round((epoch_us(done) - epoch_us(opened)) / 1000.0e0) AS BIGINT), '}}') AS properties
  FROM v_all WHERE opened IS NOT NULL
  UNION ALL SELECT library_id, session_id, done, '{m.TOGGLE_COUNT}',
    concat('{{"presses":', coalesce(presses, 0), ',"distinctPhotos":', coalesce(photos, 0), '}}') FROM v_all
  UNION ALL SELECT library_id, session_id, done, '{m.CURATION_FUNNEL}',
    concat('{{"uploaded":', coalesce(uploaded, 0), ',"autoKept":', coalesce(auto_kept, 0), ',"userKept":', coalesce(user_kept, 0), '}}') FROM v_all
  UNION ALL SELECT library_id, session_id, done, '{m.QUALITY_ERRORS}',
    concat('{{', {", ',', ".join(f"""'"{c}":', coalesce({c}, 0)""" for c in _CELLS)}, ',"nullQuality":', coalesce(null_quality, 0), '}}') FROM v_all)"""


V_DONE = done_sql(V_PRESS)


def library() -> Column:
    return F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("library_id")


def session() -> Column:
    return F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id")


def opened(spark: SparkSession, sf: str) -> DataFrame:
    return views.events(spark, sf).where("event_type = 'signup'").groupBy(session()).agg(F.min("ts").alias("started_at"))


def marked(spark: SparkSession, sf: str) -> DataFrame:
    return views.selection(spark, sf).withColumnsRenamed({"auto": "is_auto", "kept": "is_kept"})


def uploads(photos: DataFrame) -> DataFrame:
    return photos.groupBy("library_id").agg(F.count("*").alias("uploaded"))


def completions(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    finishes = e.where("event_type = 'purchase'").select(library(), session(), F.col("ts").alias("finished_at"))
    clicks = e.where("event_type = 'click'").select(
        library(), (F.col("event_id") % 50).alias("photo_id"), F.col("event_id").alias("seq"), F.lit("flip").alias("action"))
    photos = marked(spark, sf)
    return emitted(finishes.join(opened(spark, sf), "session_id", "left"), clicks, photos, uploads(photos))


@query("completion_events", f"""WITH {V_DONE}
SELECT library_id, session_id, epoch_us(server_ts) AS at_us, event_name, properties FROM v_events""")
def completion_events(spark: SparkSession, sf: str) -> DataFrame:
    return completions(spark, sf).select("library_id", "session_id", F.unix_micros("server_ts").alias("at_us"), "event_name", "properties")


@query("completed_toggles_by_day", f"""WITH {V_DONE}
SELECT strftime(done, '%Y-%m-%d') AS day, count(*) AS sessions, round(sum(coalesce(presses, 0))::DECIMAL(20,6) / count(*), 1)::DOUBLE AS avg_presses,
       round(sum(coalesce(photos, 0))::DECIMAL(20,6) / count(*), 1)::DOUBLE AS avg_distinct_photos FROM v_all GROUP BY 1""")
def completed_toggles_by_day(spark: SparkSession, sf: str) -> DataFrame:
    daily = usage_metrics.as_text_day(m.toggles_by_day(completions(spark, sf)))
    return daily.withColumns({c: F.col(c).cast("double") for c in ("avg_presses", "avg_distinct_photos")})


@query("completed_funnel_by_day", f"""WITH {V_DONE}
SELECT strftime(done, '%Y-%m-%d') AS day, count(*) AS sessions, CAST(sum(uploaded) AS BIGINT) AS uploaded, CAST(sum(auto_kept) AS BIGINT) AS auto_kept,
       CAST(sum(user_kept) AS BIGINT) AS user_kept FROM v_all GROUP BY 1""")
def completed_funnel_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return usage_metrics.as_text_day(m.funnel_by_day(completions(spark, sf))).select("day", "sessions", "uploaded", "auto_kept", "user_kept")


@query("completed_quality_errors", f"""WITH {V_DONE}
SELECT c AS cell, bucket, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (
  {' UNION ALL '.join(f"SELECT '{c}' AS c, '{m.BUCKETS[i]}' AS bucket, {c}_q{i} AS n FROM v_all" for c in ("fp", "fn") for i in range(4))}) GROUP BY 1, 2""")
def completed_quality_errors(spark: SparkSession, sf: str) -> DataFrame:
    return m.quality_error_buckets(completions(spark, sf))
