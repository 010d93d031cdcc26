"""Streaming queries, run over the given files until they are used up, checked against batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.catalog import duplicates, usage_metrics, views
from albumforge.catalog.event_intake import DAY_SECONDS, V_BATCHES, raw_batches
from albumforge.catalog.registry import ORACLES, query
from albumforge.catalog.stream_completions import LATE, timed_events
from albumforge.functions import pixels as px
from albumforge.functions.times import instant_of
from albumforge.operators import metrics as m
from albumforge.session import shared_dir
from albumforge.sources import telemetry
from albumforge.streaming import intake, photos, usage
from albumforge.streaming.running import append_events, append_values, drain, files_for, last_state, latest, record_first, slice_stream, use_rocksdb, watermark_of, write_slices

# A batch's body has some 10 kB.
BATCHES_PER_FILE = 5000


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream: one file, or a folder of part files."""
    path = f"{sf}/{name}.parquet"
    at_rest = spark.read.parquet(path)
    reader = spark.readStream.schema(at_rest.schema)
    # A stream reads folders only, so a single file is picked out of the one it lies in.
    if any(f.endswith(f"/{name}.parquet") for f in at_rest.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    return reader.parquet(path)


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return stream_of(spark, sf, "events").withColumn("ts", instant_of(F.col("ts")))


def batch_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Request batches written out as files, in time slices of several files, and read back a slice at a time."""
    path = f"{shared_dir(spark)}/albumforge-batches-{uuid.uuid4().hex}"
    # Bodies are put together once; every slice is cut from the stored ones.
    raw_batches(spark, sf).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    files = files_for(rows, BATCHES_PER_FILE)
    write_slices(rows, "received_at", f"{path}/in", files=files, form="json")
    return telemetry.batch_stream(spark, f"{path}/in", files_per_trigger=files)


@query("stream_accepted_events", f"""WITH {V_BATCHES}
SELECT e.batch_id, CAST(e.event_no AS INT) AS event_no, e.session_id, e.event_name, s.ua_bucket
FROM v_ev e JOIN v_outcome s ON e.batch_id = s.batch_id WHERE s.reject_reason IS NULL AND e.valid""")
def stream_accepted_events(spark: SparkSession, sf: str) -> DataFrame:
    use_rocksdb(spark)
    return drain(intake.accepted_rows(batch_stream(spark, sf), DAY_SECONDS, 1)).select(
        "batch_id", "event_no", "session_id", "event_name", "ua_bucket")


@query("stream_rejected_batches", f"""WITH {V_BATCHES}
SELECT batch_id, ua_bucket, reject_reason FROM v_outcome WHERE reject_reason IS NOT NULL""")
def stream_rejected_batches(spark: SparkSession, sf: str) -> DataFrame:
    use_rocksdb(spark)
    return drain(intake.rejected_batches(batch_stream(spark, sf), DAY_SECONDS, 1)).select("batch_id", "ua_bucket", "reject_reason")


@query("stream_rate_flags", """WITH r AS (SELECT event_id AS batch_id, concat('s', user_id % 7) AS rate_key, ts FROM events)
SELECT batch_id, rate_key, count(*) OVER (PARTITION BY rate_key ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999' SECOND PRECEDING AND CURRENT ROW) > 3 AS rate_limited FROM r""")
def stream_rate_flags(spark: SparkSession, sf: str) -> DataFrame:
    use_rocksdb(spark)
    known = F.col("event_type") != "clock"
    requests = timed_events(spark, sf).select(
        F.col("event_id").alias("batch_id"), F.when(known, F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string"))).alias("rate_key"),
        F.col("ts").alias("received_at"))
    return drain(intake.rate_flags(requests, 3600, 3)).select("batch_id", "rate_key", "rate_limited")


@query("stream_photo_sessions", """WITH p AS (SELECT user_id % 10 AS library_id, ts FROM events WHERE event_type <> 'error'),
s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY library_id ORDER BY ts) > INTERVAL 45 MINUTE THEN 1 ELSE 0 END AS b FROM p),
g AS (SELECT *, sum(b) OVER (PARTITION BY library_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM s),
c AS (SELECT library_id, no, min(ts) AS a, max(ts) AS z, count(*) AS photos FROM g GROUP BY 1, 2)
SELECT library_id, epoch_us(a) AS first_us, epoch_us(z) AS last_us, photos FROM c""")
def stream_photo_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_stream(spark, sf).where("event_type <> 'error'").select((F.col("user_id") % 10).alias("library_id"), "ts")
    return last_state(drain(photos.photo_sessions(rows), "complete")).select(
        "library_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "photos")


@query("stream_near_duplicates", f"""WITH {duplicates.WALK_SQL}
SELECT CAST(library_id AS VARCHAR) AS library_id, photo_id, status, rep_id, distance FROM v_walk""")
def stream_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    use_rocksdb(spark)
    v = stream_of(spark, sf, "embeddings")
    i = F.col("vec_id")
    rows = v.select(F.col("label").alias("library_id"), i.alias("name_no"), F.concat(F.lit("photo_"), i.cast("string")).alias("photo_id"),
                    F.when(i % 9 != 4, px.block_hash(F.col("embedding"))).alias("hash"))
    return drain(photos.near_duplicates(rows, duplicates.THRESHOLD)).select("library_id", "photo_id", "status", "rep_id", "distance")


@query("stream_near_duplicates_in_pieces", f"""WITH {duplicates.WALK_SQL}
SELECT library_id, photo_id, status, rep_id, distance, nearest_distance FROM v_walk""")
def stream_near_duplicates_in_pieces(spark: SparkSession, sf: str) -> DataFrame:
    v = views.table(spark, sf, "embeddings")
    i = F.col("vec_id")
    rows = v.select(F.col("label").alias("library_id"), i.alias("name_no"), F.concat(F.lit("photo_"), i.cast("string")).alias("photo_id"),
                    F.when(i % 9 != 4, px.block_hash(F.col("embedding"))).alias("hash"))
    path = f"{shared_dir(spark)}/albumforge-walk-{uuid.uuid4().hex}"
    write_slices(rows, "name_no", f"{path}/in")
    photos.record_near_duplicates(slice_stream(spark, rows.schema, f"{path}/in"), f"{path}/out", f"{path}/checkpoint", duplicates.THRESHOLD,
                                  available_now=True).awaitTermination()
    return photos.recorded_near_duplicates(spark, f"{path}/out").select("library_id", "photo_id", "status", "rep_id", "distance", "nearest_distance")


def metric_stream(spark: SparkSession, sf: str, stored: str, event_name: str, **props) -> DataFrame:
    e = event_stream(spark, sf).where(F.col("event_type") == stored).withColumn(
        "k", F.regexp_replace("props", "[^0-9]", "").cast("int"))
    return e.select(F.lit(event_name).alias("event_name"), F.col("ts").alias("server_ts"),
                    F.to_json(F.struct(*[v.alias(n) for n, v in props.items()])).alias("properties"))


# By metric query: the stored event type, the event it stands for, and its properties.
EVENTS: dict[str, tuple] = {}


def register_daily(metric: str, batch_name: str, stored: str, event_name: str, props) -> None:
    EVENTS[batch_name] = (stored, event_name, props)

    @query(f"stream_{batch_name}", ORACLES[batch_name])
    def run(spark: SparkSession, sf: str) -> DataFrame:
        updates = drain(usage.daily_metric(metric_stream(spark, sf, stored, event_name, **props()), metric), "update")
        keys = ["day", *[c for c in ("bail_from", "source", "detail") if c in updates.columns]]
        return usage_metrics.as_text_day(latest(updates, keys))


register_daily("uploads", "uploads_by_day", "signup", m.PHOTOS_UPLOADED, lambda: {"count": F.col("k")})
register_daily("toggles", "toggles_by_day", "click", m.TOGGLE_COUNT,
               lambda: {"presses": F.col("k") + 3, "distinctPhotos": F.col("k") % 13})
register_daily("funnel", "funnel_by_day", "purchase", m.CURATION_FUNNEL,
               lambda: {"uploaded": F.col("k") + 50, "autoKept": F.col("k") % 7, "userKept": F.col("k") % 11})
register_daily("bail_outs", "bail_outs_by_day", "error", m.BAIL_OUT,
               lambda: {"from": F.when(F.col("k") % 3 == 0, "back").otherwise("tab_close")})
register_daily("errors", "errors_by_day", "error", m.ERROR, lambda: {
    "source": F.when(F.col("k") % 3 == 0, "pipeline").when(F.col("k") % 3 == 1, "finalize").otherwise("compat"),
    "name": F.when(F.col("k") % 3 < 2, F.when(F.col("k") % 2 == 0, "TypeError").otherwise("Error")),
    "failed": F.when((F.col("k") % 3 == 2) & (F.col("k") % 5 > 0), "worker,canvas")})


@query("stream_replayed_choices", f"""WITH RECURSIVE {views.V_ACTIONS},
o AS (SELECT *, row_number() OVER (PARTITION BY library_id, photo_id ORDER BY seq) AS n FROM v_actions),
w AS (
  SELECT library_id, photo_id, n, action <> 'off' AS kept FROM o WHERE n = 1
  UNION ALL
  SELECT o.library_id, o.photo_id, o.n, CASE o.action WHEN 'on' THEN TRUE WHEN 'off' THEN FALSE ELSE NOT w.kept END
  FROM w JOIN o ON o.library_id = w.library_id AND o.photo_id = w.photo_id AND o.n = w.n + 1)
SELECT library_id, photo_id, arg_max(kept, n) AS kept, max(n) AS presses FROM w GROUP BY 1, 2""")
def stream_replayed_choices(spark: SparkSession, sf: str) -> DataFrame:
    use_rocksdb(spark)
    rows = stream_of(spark, sf, "conversations").select(
        F.col("conv_id").alias("library_id"), (F.col("turn") % 3).alias("photo_id"), F.col("turn").alias("seq"),
        F.when(F.col("role") == "user", "on").when(F.col("role") == "assistant", "off").otherwise("flip").alias("action"))
    updates = drain(usage.replay(rows), "update")
    last = F.max_by(F.struct("kept", "presses"), "batch_no").alias("s")
    return updates.groupBy("library_id", "photo_id").agg(last).select("library_id", "photo_id", "s.kept", "s.presses")


@query("stream_first_completions", "SELECT concat('s', user_id) AS session_id, epoch_us(min(ts)) AS first_us FROM events WHERE event_type = 'purchase' GROUP BY 1")
def stream_first_completions(spark: SparkSession, sf: str) -> DataFrame:
    """Every session finishes in several slices, days apart, and comes out once."""
    rows = timed_events(spark, sf).where("event_type = 'purchase'").select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("ts").alias("server_ts"))
    path = f"{shared_dir(spark)}/albumforge-firsts-{uuid.uuid4().hex}"
    record_first(rows, ["session_id"], "server_ts", f"{path}/table", f"{path}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(f"{path}/table").select("session_id", F.unix_micros("server_ts").alias("first_us"))


@query("stream_event_table", f"""WITH {V_BATCHES}
SELECT strftime(s.received_at, '%Y-%m-%d') AS day, e.event_name, count(*) AS events, count(*) AS ids
FROM v_ev e JOIN v_outcome s ON e.batch_id = s.batch_id WHERE s.reject_reason IS NULL AND e.valid GROUP BY 1, 2""")
def stream_event_table(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of batches within the limit appended to the event table by day, then read back by name."""
    use_rocksdb(spark)
    base = f"{shared_dir(spark)}/albumforge-events-{uuid.uuid4().hex}"
    rows = intake.accepted_rows(batch_stream(spark, sf), DAY_SECONDS, 1)
    append_events(rows, f"{base}/table", f"{base}/checkpoint", available_now=True).awaitTermination()
    return telemetry.read_events(spark, f"{base}/table").groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_name").agg(
        F.count("*").alias("events"), F.countDistinct("id").alias("ids"))


def timing_events(events: DataFrame, stored: str, event_name: str, **props) -> DataFrame:
    e = events.withColumn("k", F.regexp_replace("props", "[^0-9]", "").cast("int"))
    return e.select(F.when(F.col("event_type") == stored, event_name).alias("event_name"), F.col("ts").alias("server_ts"),
                    F.to_json(F.struct(*[v.alias(n) for n, v in props.items()])).alias("properties"))


def run_timings(spark: SparkSession, sf: str, metric: str, stored: str, event_name: str, props) -> tuple[DataFrame, DataFrame, Column]:
    """Latest sketches, stored values, and the time before which days are closed, after the stream has run.

    The clock's own event has a name of its own: it takes part as a sample of no metric.
    """
    events = timing_events(timed_events(spark, sf), stored, event_name, **props())
    path = f"{shared_dir(spark)}/albumforge-timings-{uuid.uuid4().hex}"
    append_values(usage.timing_values(events, metric), f"{path}/values", f"{path}/values-checkpoint", available_now=True).awaitTermination()
    timed = usage.timing_values(events.withWatermark("server_ts", LATE), metric)
    ran: list = []
    updates = drain(usage.day_sketches(timed), "update", ran)
    values = spark.read.schema("server_ts timestamp, stage string, ms decimal(20,6), day date").parquet(f"{path}/values")
    return latest(updates, ["day", "stage"]), values, watermark_of(ran[0])


def register_timing(metric: str, batch_name: str, stored: str, event_name: str, props) -> None:
    EVENTS[batch_name] = (stored, event_name, props)

    @query(f"stream_{batch_name}", ORACLES[batch_name])
    def run(spark: SparkSession, sf: str) -> DataFrame:
        sketches, values, closed = run_timings(spark, sf, metric, stored, event_name, props)
        if metric == "stage_durations":
            return usage_metrics.as_text_day(m.timing(values, ["stage"], F.col("ms")))
        return usage_metrics.as_text_day(usage.timings_now(sketches, values, closed))


register_timing("time_to_curation", "time_to_curation_by_day", "view", m.TIME_TO_CURATION, lambda: {"ms": F.col("event_id") * 37 % 90000 + F.col("k")})
register_timing("curation_duration", "curation_duration_by_day", "click", m.CURATION_DURATION, lambda: {"ms": F.col("event_id") * 101 % 7000 + F.col("k")})
register_timing("stage_durations", "stage_durations", "view", m.STAGE_DURATION, lambda: {
    "exif": F.col("k") * 3, "dedup": F.col("event_id") % 5000, "cluster": F.col("event_id") % 7, "thumbnail": F.when(F.col("k") % 4 > 0, F.col("event_id") * 13 % 100003)})
