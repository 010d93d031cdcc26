"""Completion events and bail-outs of streams, over three time slices and a clock that moves on behind them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.catalog import completions, views
from albumforge.catalog.registry import query
from albumforge.operators.completion import library_facts
from albumforge.session import cut_lineage, shared_dir
from albumforge.streaming import completion as live
from albumforge.streaming.running import drain, files_for, slice_stream, use_rocksdb, write_slices

# How long a session lasts, and how late a row may come.
LONGEST, LATE = "7 days", "1 day"
KIND = "CASE WHEN CAST(regexp_replace(props, '[^0-9]', '', 'g') AS INT) % 3 = 0 THEN 'back' ELSE 'tab_close' END"


def timed_events(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as a stream of three slices, oldest first, with a row a year later that only moves the clock."""
    path = f"{shared_dir(spark)}/albumforge-usage-{uuid.uuid4().hex}"
    rows = views.events(spark, sf).select("event_id", "user_id", "event_type", "ts", "props")
    closing = cut_lineage(rows.agg(F.max("ts").alias("last"))).select(
        # A join asks for its key before the watermark is read, so the row has one.
        F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("clock").alias("event_type"),
        (F.col("last") + F.expr("INTERVAL 365 DAYS")).alias("ts"), F.lit(None).cast("string").alias("props"))
    files = files_for(rows)
    write_slices(rows, "ts", path, files=files, closing=closing)
    return slice_stream(spark, rows.schema, path, files)


def finishes(events: DataFrame) -> DataFrame:
    rows = events.select("event_type", completions.library(), completions.session(), F.col("ts").alias("finished_at")).withWatermark("finished_at", LATE)
    return live.of_kind(rows, "finished_at", F.col("event_type") == "purchase").drop("event_type")


@query("stream_completion_events", f"""WITH {completions.done_sql(f"""
v_press AS (SELECT s.library_id, s.session_id, count(*) AS presses, count(DISTINCT event_id % 50) AS photos
  FROM v_sess s JOIN events e ON e.event_type = 'click' AND concat('s', e.user_id) = s.session_id AND e.ts <= s.done AND e.ts >= s.done - INTERVAL {LONGEST} GROUP BY 1, 2)""")}
SELECT library_id, session_id, epoch_us(server_ts) AS at_us, event_name, properties FROM v_events""")
def stream_completion_events(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions finish again and again in later slices, long after the clock passed their first finish: they report once."""
    events = timed_events(spark, sf)
    kind = F.when(F.col("event_type") == "click", "press").when(F.col("event_type") == "purchase", "finish")
    usage = events.select(completions.library(), completions.session(), kind.alias("kind"), (F.col("event_id") % 50).alias("photo_id"), F.col("ts").alias("at"))
    photos = completions.marked(spark, sf)
    path = f"{shared_dir(spark)}/albumforge-completions-{uuid.uuid4().hex}"
    # Every micro-batch looks both up, so they are worked out once.
    started, facts = cut_lineage(completions.opened(spark, sf)), cut_lineage(library_facts(photos, completions.uploads(photos)))
    live.record_usage(usage, started, facts, path, f"{path}/checkpoint", LONGEST, LATE, available_now=True).awaitTermination()
    return spark.read.parquet(f"{path}/table").select("library_id", "session_id", F.unix_micros("server_ts").alias("at_us"), "event_name", "properties")


@query("stream_bail_outs", f"""WITH l AS (SELECT concat('s', user_id) AS session_id, ts, {KIND} AS kind FROM events WHERE event_type = 'error')
SELECT session_id, kind, epoch_us(ts) AS left_us FROM l WHERE kind = 'back' OR NOT EXISTS (
  SELECT 1 FROM events f WHERE f.event_type = 'purchase' AND concat('s', f.user_id) = l.session_id AND f.ts <= l.ts AND f.ts >= l.ts - INTERVAL {LONGEST})""")
def stream_bail_outs(spark: SparkSession, sf: str) -> DataFrame:
    use_rocksdb(spark)
    events = timed_events(spark, sf)
    k = F.regexp_replace("props", "[^0-9]", "").cast("int")
    left = events.select(completions.session(), F.when(F.col("event_type") == "error", F.when(k % 3 == 0, "back").otherwise("tab_close")).alias("kind"), F.col("ts").alias("left_at"))
    return drain(live.bail_outs(left.withWatermark("left_at", LATE), finishes(events), LONGEST)).select("session_id", "kind", F.unix_micros("left_at").alias("left_us"))
