"""From raw request bodies to event rows: batch checks, rate limit, clean rows.

Input has ``batch_id``, ``received_at``, ``user_agent`` and ``body`` (JSON text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumforge.functions import telemetry as t
from albumforge.operators.ordering import neighbours, running, with_positions
from albumforge.session import cut_lineage


def read_batches(raw: DataFrame) -> DataFrame:
    """Add the parsed events, the browser bucket, the rate key and the first reject reason."""
    # The parser stops at the end of the first value; the closing field shows nothing follows it.
    doc = F.try_parse_json(F.concat(F.lit('{"body":'), F.col("body"), F.lit(',"complete":true}')))
    parsed = (
        raw.withColumn("_doc", doc)
        .withColumn("_events", F.try_variant_get("_doc", "$.body.events", "array<variant>"))
        # The same events as text, which keeps the key order of their properties.
        .withColumn("_texts", F.from_json("body", "events array<string>")["events"])
        .withColumn("ua_bucket", t.browser_bucket(F.col("user_agent")))
    )
    size = F.coalesce(F.size("_events"), F.lit(0))
    first_session = t.text_field(F.get("_events", F.lit(0)), "session_id")
    return (
        parsed.withColumn(
            "reject_reason",
            F.when(~F.coalesce(F.try_variant_get("_doc", "$.complete", "boolean"), F.lit(False)), "bad json")
            .when(~size.between(1, t.MAX_EVENTS_PER_BATCH), "bad batch"))
        .withColumn("rate_key", F.coalesce(first_session, F.col("ua_bucket")))
        .drop("_doc")
    )


def parsed_events(formed: DataFrame) -> DataFrame:
    """``read_batches`` for batches known to pass its checks: their events, and no reject reason."""
    doc = F.try_parse_json("body")
    return formed.select(
        "*", F.try_variant_get(doc, "$.events", "array<variant>").alias("_events"),
        F.from_json("body", "events array<string>")["events"].alias("_texts"),
        t.browser_bucket(F.col("user_agent")).alias("ua_bucket"), F.lit(None).cast("string").alias("reject_reason"))


def mark_rate(batches: DataFrame, window_seconds: int = t.RATE_WINDOW_SECONDS,
              max_requests: int = t.RATE_MAX_REQUESTS) -> DataFrame:
    """Flag requests over the limit of their key; rejected requests count too.

    A request is over the limit when the one ``max_requests`` places before it
    is still inside the window, so one look back replaces the count, and a key
    with any number of requests is worked on in blocks. Requests at the same
    instant are served in batch order.
    """
    placed = with_positions(batches.withColumn("_us", F.unix_micros("received_at")), ["rate_key"],
                            [F.col("_us").asc(), F.col("batch_id").asc()], out="_no")
    looked = neighbours(placed, ["rate_key"], "_no", before={"_then": "_us"}, offset=max_requests)
    limited = F.coalesce(F.col("_us") - F.col("_then") < window_seconds * 1_000_000, F.lit(False))
    return looked.withColumn("rate_limited", limited).drop("_us", "_no", "_then")


def recent_requests(batches: DataFrame, window_seconds: int = t.RATE_WINDOW_SECONDS) -> DataFrame:
    """How many requests of the key fall in the window that ends with the request, itself included.

    Every request also puts a probe one window earlier. In one order of both,
    the requests up to the probe are those that are too old.
    """
    us = F.unix_micros("received_at")
    both = batches.select("rate_key", "batch_id", F.inline(F.array(
        F.struct(us.alias("_us"), F.lit(0).alias("_probe")),
        F.struct((us - window_seconds * 1_000_000).alias("_us"), F.lit(1).alias("_probe")))))
    placed = with_positions(both.withColumn("_one", 1 - F.col("_probe")), ["rate_key"],
                            [F.col("_us").asc(), F.col("_probe").asc(), F.col("batch_id").asc()])
    counted = running(placed, ["rate_key"], "_one", "_seen")
    seen = lambda probe: F.sum(F.when(F.col("_probe") == probe, F.col("_seen")))
    return counted.groupBy("rate_key", "batch_id").agg((seen(0) - seen(1)).alias("recent_requests"))


def event_rows(batches: DataFrame) -> DataFrame:
    """One clean row per valid event of accepted batches."""
    exploded = (
        batches.where(F.col("reject_reason").isNull())
        .select("batch_id", "received_at", "ua_bucket",
                F.posexplode(F.arrays_zip(F.col("_events").alias("v"), F.col("_texts").alias("t"))).alias("event_no", "_e"))
    )
    v = F.col("_e.v")
    raw_props = F.get_json_object(F.col("_e.t"), "$.properties")
    # What is no object has no session and drops out with the faulty ones below.
    rows = exploded.select(
        "batch_id", "event_no",
        t.text_field(v, "session_id").alias("session_id"),
        t.text_field(v, "event_name").alias("event_name"),
        t.clean_properties(raw_props).alias("properties"),
        F.try_to_timestamp(t.text_field(v, "client_ts")).alias("client_ts"),
        F.col("received_at").alias("server_ts"),
        F.substring(t.text_field(v, "app_version"), 1, t.MAX_VERSION).alias("app_version"),
        "ua_bucket",
    )
    return rows.where(
        F.col("session_id").isNotNull() & F.col("event_name").isNotNull()
        & (F.length("event_name") <= t.MAX_NAME)
    ).withColumn("session_id", F.substring("session_id", 1, t.MAX_SESSION))


def has_valid_event(events: str = "_events"):
    """Whether any event of the batch would become a row."""
    return F.exists(events, lambda v: (
        t.text_field(v, "session_id").isNotNull()
        & F.coalesce(F.length(t.text_field(v, "event_name")) <= t.MAX_NAME, F.lit(False))))


def batch_outcomes(raw: DataFrame, window_seconds: int = t.RATE_WINDOW_SECONDS,
                   max_requests: int = t.RATE_MAX_REQUESTS) -> DataFrame:
    """Every batch with its reject reason (null when accepted). Only well-formed batches count for the rate."""
    # Bodies are parsed once; only key, time and id are ordered, and only limited ids come back.
    read = cut_lineage(read_batches(raw))
    slim = read.where(F.col("reject_reason").isNull()).select("batch_id", "rate_key", "received_at")
    limited = mark_rate(slim, window_seconds, max_requests).where("rate_limited").select("batch_id", "rate_limited")
    judged = read.join(limited, "batch_id", "left").withColumn("rate_limited", F.coalesce("rate_limited", F.lit(False)))
    return judged.withColumn("reject_reason", F.coalesce(
        "reject_reason", F.when(F.col("rate_limited"), "rate limited").when(~has_valid_event(), "no valid events")))
