"""Usage metrics on JSON built from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.catalog import views
from albumforge.catalog.registry import query
from albumforge.operators import metrics as m


def K():
    return F.col("k")


def I():
    return F.col("event_id")



def metric_events(spark: SparkSession, sf: str, stored: str, event_name: str, /, **props) -> DataFrame:
    """Events of one stored type, renamed, with a JSON body."""
    rows = views.telemetry(spark, sf).where(F.col("event_name") == stored)
    body = F.to_json(F.struct(*[v.alias(k) for k, v in props.items()]))
    return rows.select("session_id", F.lit(event_name).alias("event_name"), "server_ts", "event_id", body.alias("properties"))


def as_text_day(df: DataFrame) -> DataFrame:
    out = df.withColumn("day", F.date_format("day", "yyyy-MM-dd")) if "day" in df.columns else df
    return out.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c)
                        for c, t in out.dtypes])


DAY = "strftime(server_ts, '%Y-%m-%d')"


def half_up(total: str, n: str, digits: int) -> str:
    """total / n rounded half up to ``digits``, in whole numbers."""
    p = 10 ** digits
    return f"CAST((2 * {p} * CAST({total} AS HUGEINT) + {n}) // (2 * {n}) AS DOUBLE) / {p}.0e0"


@query("uploads_by_day", f"""WITH {views.V_TELEMETRY}
SELECT {DAY} AS day, count(*) AS upload_events, CAST(sum(k) AS BIGINT) AS total_photos,
       {half_up('sum(k)', 'count(*)', 1)} AS avg_photos_per_upload
FROM v_telemetry WHERE event_name = 'signup' GROUP BY 1""")
def uploads_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return as_text_day(m.uploads_by_day(metric_events(spark, sf, "signup", m.PHOTOS_UPLOADED, count=K())))


TIMING = """samples, {avg} AS avg_ms,
       round_even(quantile_cont(CAST(x AS DOUBLE), 0.5), 0) AS p50_ms,
       round_even(quantile_cont(CAST(x AS DOUBLE), 0.95), 0) AS p95_ms"""


@query("time_to_curation_by_day", f"""WITH {views.V_TELEMETRY}, t AS (
  SELECT {DAY} AS day, event_id * 37 % 90000 + k AS x FROM v_telemetry WHERE event_name = 'view')
SELECT day, count(*) AS {TIMING.format(avg=half_up('sum(x)', 'count(*)', 0))} FROM t GROUP BY 1""")
def time_to_curation_by_day(spark: SparkSession, sf: str) -> DataFrame:
    ev = metric_events(spark, sf, "view", m.TIME_TO_CURATION, ms=I() * 37 % 90000 + K())
    return as_text_day(m.timing_by_day(ev, m.TIME_TO_CURATION))


@query("curation_duration_by_day", f"""WITH {views.V_TELEMETRY}, t AS (
  SELECT {DAY} AS day, event_id * 101 % 7000 + k AS x FROM v_telemetry WHERE event_name = 'click')
SELECT day, count(*) AS {TIMING.format(avg=half_up('sum(x)', 'count(*)', 0))} FROM t GROUP BY 1""")
def curation_duration_by_day(spark: SparkSession, sf: str) -> DataFrame:
    ev = metric_events(spark, sf, "click", m.CURATION_DURATION, ms=I() * 101 % 7000 + K())
    return as_text_day(m.timing_by_day(ev, m.CURATION_DURATION))


@query("toggles_by_day", f"""WITH {views.V_TELEMETRY}
SELECT {DAY} AS day, count(*) AS sessions, {half_up('sum(k + 3)', 'count(*)', 1)} AS avg_presses,
       {half_up('sum(k % 13)', 'count(*)', 1)} AS avg_distinct_photos
FROM v_telemetry WHERE event_name = 'click' GROUP BY 1""")
def toggles_by_day(spark: SparkSession, sf: str) -> DataFrame:
    ev = metric_events(spark, sf, "click", m.TOGGLE_COUNT, presses=K() + 3, distinctPhotos=K() % 13)
    return as_text_day(m.toggles_by_day(ev))


@query("funnel_by_day", f"""WITH {views.V_TELEMETRY}
SELECT {DAY} AS day, count(*) AS sessions, CAST(sum(k + 50) AS BIGINT) AS uploaded,
       CAST(sum(k % 7) AS BIGINT) AS auto_kept, CAST(sum(k % 11) AS BIGINT) AS user_kept,
       round(avg(CAST(k % 11 AS DOUBLE) / nullif(k % 7, 0)), 2) AS user_vs_auto,
       round(avg(CAST(k % 11 AS DOUBLE) / (k + 50)), 3) AS keep_rate
FROM v_telemetry WHERE event_name = 'purchase' GROUP BY 1""")
def funnel_by_day(spark: SparkSession, sf: str) -> DataFrame:
    ev = metric_events(spark, sf, "purchase", m.CURATION_FUNNEL, uploaded=K() + 50, autoKept=K() % 7, userKept=K() % 11)
    return as_text_day(m.funnel_by_day(ev))


@query("stage_durations", f"""WITH {views.V_TELEMETRY}, t AS (
  SELECT 'exif' AS stage, k * 3 AS x FROM v_telemetry WHERE event_name = 'view'
  UNION ALL SELECT 'dedup', event_id % 5000 FROM v_telemetry WHERE event_name = 'view'
  UNION ALL SELECT 'cluster', event_id % 7 FROM v_telemetry WHERE event_name = 'view'
  UNION ALL SELECT 'thumbnail', event_id * 13 % 100003 FROM v_telemetry WHERE event_name = 'view' AND k % 4 > 0)
SELECT stage, count(*) AS {TIMING.format(avg=half_up('sum(x)', 'count(*)', 0))} FROM t GROUP BY 1""")
def stage_durations(spark: SparkSession, sf: str) -> DataFrame:
    ev = metric_events(spark, sf, "view", m.STAGE_DURATION, exif=K() * 3, dedup=I() % 5000, cluster=I() % 7,
                       thumbnail=F.when(K() % 4 > 0, I() * 13 % 100003))
    return as_text_day(m.stage_durations(ev))


@query("bail_outs_by_day", f"""WITH {views.V_TELEMETRY}
SELECT {DAY} AS day, CASE WHEN k % 3 = 0 THEN 'back' ELSE 'tab_close' END AS bail_from, count(*) AS bail_outs
FROM v_telemetry WHERE event_name = 'error' GROUP BY 1, 2""")
def bail_outs_by_day(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(K() % 3 == 0, F.lit("back")).otherwise(F.lit("tab_close"))
    out = m.bail_outs_by_day(metric_events(spark, sf, "error", m.BAIL_OUT, **{"from": kind}))
    return as_text_day(m.view_order(out, "day", "bail_outs"))


@query("errors_by_day", f"""WITH {views.V_TELEMETRY}
SELECT {DAY} AS day, CASE k % 3 WHEN 0 THEN 'pipeline' WHEN 1 THEN 'finalize' ELSE 'compat' END AS source,
       CASE WHEN k % 3 < 2 THEN CASE WHEN k % 2 = 0 THEN 'TypeError' ELSE 'Error' END
            WHEN k % 5 > 0 THEN 'worker,canvas' END AS detail, count(*) AS errors
FROM v_telemetry WHERE event_name = 'error' GROUP BY 1, 2, 3""")
def errors_by_day(spark: SparkSession, sf: str) -> DataFrame:
    source = F.when(K() % 3 == 0, "pipeline").when(K() % 3 == 1, "finalize").otherwise("compat")
    name = F.when(K() % 3 < 2, F.when(K() % 2 == 0, "TypeError").otherwise("Error"))
    failed = F.when((K() % 3 == 2) & (K() % 5 > 0), "worker,canvas")
    out = m.errors_by_day(metric_events(spark, sf, "error", m.ERROR, source=source, name=name, failed=failed))
    return as_text_day(m.view_order(out, "day", "errors"))


def bucket_props():
    """tp_q2 and so on; every 17th event lacks one bucket."""
    out = {}
    for c, cell in enumerate(m.CELLS):
        for q in range(4):
            n = (I() + 4 * c + q) % (5 + c)
            out[f"{cell}_q{q}"] = F.when(I() % 17 > 0, n) if (cell, q) == ("fp", 1) else n
    out["nullQuality"] = F.when(I() % 3 > 0, I() % 4)
    return out


CELL_SQL = ", ".join(
    (f"CASE WHEN event_id % 17 > 0 THEN CAST((event_id + {4 * c + q}) % {5 + c} AS BIGINT) END" if (cell, q) == ("fp", 1)
     else f"CAST((event_id + {4 * c + q}) % {5 + c} AS BIGINT)") + f" AS {cell}{q}"
    for c, cell in enumerate(m.CELLS) for q in range(4))


def share_sql(total8: str, n: str, unit: int) -> str:
    return f"CASE WHEN {n} > 0 THEN {half_up(total8, f'({unit} * ({n}))', 3)} END"


@query("quality_errors_by_day", f"""WITH {views.V_TELEMETRY},
cells AS (SELECT {DAY} AS day, {CELL_SQL}, CASE WHEN event_id % 3 > 0 THEN event_id % 4 ELSE 0 END AS nq
          FROM v_telemetry WHERE event_name = 'purchase'),
totals AS (SELECT day, count(*) AS sessions, CAST(sum(nq) AS BIGINT) AS null_quality, {', '.join(
    f"CAST(sum({c}0 + {c}1 + {c}2 + {c}3) AS BIGINT) AS {c}, CAST(sum({c}0 + 3 * {c}1 + 5 * {c}2 + 7 * {c}3) AS BIGINT) AS {c}_8"
    for c in m.CELLS)} FROM cells GROUP BY 1)
SELECT day, sessions, tp, fp, fn, tn, null_quality,
       {share_sql('tp', 'tp + fp', 1)} AS precision, {share_sql('tp', 'tp + fn', 1)} AS recall,
       {', '.join(f"{share_sql(f'{c}_8', c, 8)} AS {c}_mean_quality" for c in m.CELLS)}
FROM totals""")
def quality_errors_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return as_text_day(m.quality_errors_by_day(metric_events(spark, sf, "purchase", m.QUALITY_ERRORS, **bucket_props())))


@query("quality_error_buckets", f"""WITH {views.V_TELEMETRY},
cells AS (SELECT {CELL_SQL} FROM v_telemetry WHERE event_name = 'purchase')
{' UNION ALL '.join(f"SELECT '{c}' AS cell, '{m.BUCKETS[i]}' AS bucket, CAST(coalesce(sum({c}{i}), 0) AS BIGINT) AS n FROM cells"
                    for c in ('fp', 'fn') for i in range(4))}""")
def quality_error_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return m.quality_error_buckets(metric_events(spark, sf, "purchase", m.QUALITY_ERRORS, **bucket_props()))


@query("stage_run_map", f"""WITH {views.V_TELEMETRY}
SELECT event_id AS run, concat('{{"exif":', k * 3, ',"dedup":', event_id % 5000, ',"cluster":', event_id % 7, '}}') AS properties
FROM v_telemetry WHERE event_name = 'view'""")
def stage_run_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.telemetry(spark, sf).where("event_name = 'view'")
    stages = F.array(*[F.struct(F.lit(n).alias("seq"), F.lit(s).alias("stage"), v.cast("bigint").alias("ms"))
                       for n, (s, v) in enumerate((("exif", K() * 3), ("dedup", I() % 5000), ("cluster", I() % 7)))])
    timings = rows.select(I().alias("run"), F.inline(stages))
    return m.stage_run_map(timings, "run")


@query("events_by_name", "SELECT user_id, count(*) AS n, sum(event_id) AS ids FROM events WHERE event_type = 'purchase' GROUP BY 1")
def events_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """The name filter reaches the file scan."""
    e = views.table(spark, sf, "events").withColumnRenamed("event_type", "event_name")
    return m.named(e, "purchase").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
