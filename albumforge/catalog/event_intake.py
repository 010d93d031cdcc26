"""Event batches: checks, rate limit, clean rows. Batches are built from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.catalog import views
from albumforge.catalog.registry import query
from albumforge.functions import telemetry as t
from albumforge.operators import intake

# Events taken per batch of 60, by batch number modulo 7: two sizes are too big.
SIZES = (60, 50, 1, 33, 51, 20, 45)
AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0",
    "Mozilla/5.0 (X11; Linux x86_64) Chrome/120.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) CriOS/120.0 Mobile Safari/604.1",
    "Mozilla/5.0 (X11; Linux) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (iPad; CPU OS 17_0) FxiOS/121.0 Mobile",
    "Mozilla/5.0 (Macintosh) Version/17.0 Safari/605.1.15",
    "Mozilla/5.0 (Linux; Android 14) Version/4.0 Safari/537.36",
    "curl/8.0",
)
BUCKETS = ("edge-desktop", "chrome-desktop", "chrome-mobile", "firefox-desktop", "firefox-mobile",
           "safari-desktop", "safari-mobile", "other-desktop")


def pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def raw_batches(spark: SparkSession, sf: str) -> DataFrame:
    """JSON bodies with every kind of fault: wrong types, long names, nested values, broken text."""
    e = views.telemetry(spark, sf)
    i = F.col("event_id")
    batch = F.floor(i / 60)
    q = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    many = F.concat(*[F.lit(f',"p{n}":{n}') for n in range(25)])
    props = F.concat(
        F.lit('{"nested":{"a":1},"k":'), F.col("k").cast("string"), F.lit(',"note":"'), F.repeat(F.lit("n"), i % 250),
        F.lit('","flag":'), (i % 2 == 0).cast("string"), F.lit(',"none":null,"list":[1,2],"half":'),
        F.col("k").cast("string"), F.lit(".5"), F.when(i % 5 == 0, many).otherwise(F.lit("")), F.lit("}"))
    body = F.concat(
        F.lit('{"session_id":'), F.when(i % 11 == 0, F.lit("12")).otherwise(q(F.col("session_id"))),
        F.lit(',"event_name":'), q(F.when(i % 13 == 0, F.repeat(F.lit("x"), F.lit(61))).otherwise(F.col("event_name"))),
        F.lit(',"client_ts":'),
        F.when(i % 3 == 0, F.lit("5")).otherwise(q(F.date_format("server_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))),
        F.lit(',"app_version":'), q(F.repeat(F.lit("v"), (i % 60 + 1).cast("int"))),
        F.lit(',"properties":'), props, F.lit("}"))
    rows = e.select(batch.alias("batch_id"), i, "server_ts", body.alias("event")).where(
        i % 60 < pick(SIZES, F.col("batch_id") % 7))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event"))), lambda s: s["event"]), ",")
    batches = rows.groupBy("batch_id").agg(F.min("server_ts").alias("received_at"), joined.alias("events"))
    full = F.concat(F.lit('{"events":['), F.col("events"), F.lit("]}"))
    return batches.select(
        "batch_id", "received_at", pick(AGENTS, F.col("batch_id") % 8).alias("user_agent"),
        F.when(F.col("batch_id") % 10 == 9, F.concat(full, F.lit(" more"))).otherwise(full).alias("body"))


V_BATCHES = views.V_TELEMETRY + f""",
v_ev AS (
  SELECT *, event_id // 60 AS batch_id, event_id % 60 AS event_no,
         event_id % 11 <> 0 AND event_id % 13 <> 0 AS valid
  FROM v_telemetry WHERE event_id % 60 < {list(SIZES)}[event_id // 60 % 7 + 1]),
v_shape AS (
  SELECT batch_id, min(server_ts) AS received_at, count(*) AS n, bool_or(valid) AS any_valid,
         {list(BUCKETS)}[batch_id % 8 + 1] AS ua_bucket,
         coalesce(max(CASE WHEN event_no = 0 AND event_id % 11 <> 0 THEN session_id END),
                  {list(BUCKETS)}[batch_id % 8 + 1]) AS rate_key,
         CASE WHEN batch_id % 10 = 9 THEN 'bad json' WHEN count(*) > 50 THEN 'bad batch' END AS shape_fault
  FROM v_ev GROUP BY batch_id),
v_rate AS (
  SELECT a.batch_id, count(*) AS recent_requests
  FROM v_shape a JOIN v_shape b ON a.rate_key = b.rate_key AND b.received_at <= a.received_at
       AND b.received_at > a.received_at - INTERVAL 1 DAY AND (b.received_at < a.received_at OR b.batch_id <= a.batch_id)
  WHERE a.shape_fault IS NULL AND b.shape_fault IS NULL GROUP BY 1),
v_outcome AS (
  SELECT s.*, r.recent_requests,
         coalesce(shape_fault, CASE WHEN r.recent_requests > 1 THEN 'rate limited' END,
                  CASE WHEN NOT any_valid THEN 'no valid events' END) AS reject_reason
  FROM v_shape s LEFT JOIN v_rate r ON s.batch_id = r.batch_id)"""

DAY_SECONDS = 86400


@query("batch_outcomes", f"""WITH {V_BATCHES}
SELECT batch_id, ua_bucket, reject_reason FROM v_outcome""")
def batch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return intake.batch_outcomes(raw_batches(spark, sf), DAY_SECONDS, 1).select(
        "batch_id", "ua_bucket", "reject_reason")


@query("accepted_events", f"""WITH {V_BATCHES}
SELECT e.batch_id, CAST(e.event_no AS INT) AS event_no, e.session_id, e.event_name, o.ua_bucket,
       repeat('v', least(e.event_id % 60 + 1, 40)::INT) AS app_version,
       CASE WHEN e.event_id % 3 <> 0 THEN strftime(e.server_ts, '%Y-%m-%d %H:%M:%S') END AS client_ts,
       concat('{{"k":', k, ',"note":"', repeat('n', least(event_id % 250, 200)::INT), '","flag":',
              CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"half":', k, '.5',
              CASE WHEN event_id % 5 = 0 THEN '{''.join(f',"p{n}":{n}' for n in range(16))}' ELSE '' END, '}}') AS properties
FROM v_ev e JOIN v_outcome o ON e.batch_id = o.batch_id WHERE o.reject_reason IS NULL AND e.valid""")
def accepted_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = intake.event_rows(intake.batch_outcomes(raw_batches(spark, sf), DAY_SECONDS, 1))
    # Objects are compared as text, so the keys are put in document order again.
    order = ["k", "note", "flag", "half", *[f"p{n}" for n in range(25)]]
    pairs = F.from_json("properties", "map<string,variant>")
    rank = F.array(*[F.lit(k) for k in order])
    keys = F.array_sort(F.transform(F.map_keys(pairs), lambda k: F.struct(F.array_position(rank, k).alias("r"), k.alias("k"))))
    text = F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda s: F.concat(
        F.lit('"'), s["k"], F.lit('":'), F.to_json(F.element_at(pairs, s["k"])))), ","), F.lit("}"))
    return rows.select("batch_id", "event_no", "session_id", "event_name", "ua_bucket", "app_version",
                       F.date_format("client_ts", "yyyy-MM-dd HH:mm:ss").alias("client_ts"), text.alias("properties"))


@query("clean_properties", f"""WITH {views.V_TELEMETRY}
SELECT event_id, concat('{{"2":"two","10":', k, ',"b":', k, '.5,"a":"', repeat('z', least(event_id % 230, 200)::INT), '"',
       CASE WHEN event_id % 2 = 0 THEN ',"on":true' ELSE '' END, '}}') AS properties FROM v_telemetry""")
def clean_properties(spark: SparkSession, sf: str) -> DataFrame:
    e, i, k = views.telemetry(spark, sf), F.col("event_id"), F.col("k").cast("string")
    raw = F.concat(F.lit('{"b":'), k, F.lit('.5,"10":'), k, F.lit(',"o":{"x":[1]},"a":"'), F.repeat(F.lit("z"), i % 230),
                   F.lit('"'), F.when(i % 2 == 0, F.lit(',"on":true')).otherwise(F.lit("")), F.lit(',"2":"two","n":null}'))
    return e.select(i, t.clean_properties(raw).alias("properties"))


@query("browser_buckets", f"""SELECT event_id, {list(BUCKETS)}[event_id % 8 + 1] AS bucket FROM events""")
def browser_buckets(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    return e.select("event_id", t.browser_bucket(pick(AGENTS, F.col("event_id") % 8)).alias("bucket"))


@query("request_rate", """WITH r AS (
  SELECT event_id AS batch_id, concat('s', user_id % 7) AS rate_key, date_trunc('minute', ts) AS received_at FROM events)
SELECT a.batch_id, n.recent_requests, n.recent_requests > 5 AS rate_limited
FROM r a JOIN (
  SELECT batch_id, count(*) OVER (PARTITION BY rate_key ORDER BY received_at RANGE BETWEEN INTERVAL '3599.999999' SECOND PRECEDING AND CURRENT ROW)
         - count(*) OVER (PARTITION BY rate_key, received_at)
         + row_number() OVER (PARTITION BY rate_key, received_at ORDER BY batch_id) AS recent_requests
  FROM r) n ON a.batch_id = n.batch_id""")
def request_rate(spark: SparkSession, sf: str) -> DataFrame:
    requests = views.events(spark, sf).select(
        F.col("event_id").alias("batch_id"), F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("rate_key"),
        F.date_trunc("minute", "ts").alias("received_at"))
    counts = intake.recent_requests(requests, 3600).select("batch_id", "recent_requests")
    return intake.mark_rate(requests, 3600, 5).select("batch_id", "rate_limited").join(counts, "batch_id")
