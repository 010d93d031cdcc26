"""Event batches checked, limited and cleaned as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from albumforge.functions.telemetry import RATE_MAX_REQUESTS, RATE_WINDOW_SECONDS
from albumforge.operators.intake import event_rows, has_valid_event, parsed_events, read_batches
from albumforge.streaming.completion import of_kind

# How far behind the newest request one may come in; the server stamps them itself, so this is its own delay.
LATE = "10 minutes"


def accepted_rows(batches: DataFrame, window_seconds: int = RATE_WINDOW_SECONDS, max_requests: int = RATE_MAX_REQUESTS, late: str = LATE) -> DataFrame:
    """Clean rows of batches that are well formed and within the limit of their key."""
    # Only batches that passed the shape checks come out of the limiter, so their bodies are not checked again.
    return event_rows(parsed_events(limited(batches, window_seconds, max_requests, late).where("NOT rate_limited")))


def rejected_batches(batches: DataFrame, window_seconds: int = RATE_WINDOW_SECONDS, max_requests: int = RATE_MAX_REQUESTS, late: str = LATE) -> DataFrame:
    """Side output: batches that leave no row, and the first reason."""
    columns = ["batch_id", "received_at", "ua_bucket", "reject_reason"]
    faulty = read_batches(batches).where(F.col("reject_reason").isNotNull()).select(*columns)
    formed = read_batches(limited(batches, window_seconds, max_requests, late))
    reason = F.when(F.col("rate_limited"), "rate limited").when(~has_valid_event(), "no valid events")
    return faulty.unionByName(formed.withColumn("reject_reason", reason).where(F.col("reject_reason").isNotNull()).select(*columns))


# Groups that keys are dealt into by hash: what is called once per group and micro-batch doesn't grow with the keys.
KEY_GROUPS = 256


class RateLimiter(StatefulProcessor):
    """Per group of keys, a list of (key, time) with the last ``max_requests`` requests of each key, until the watermark has left their window behind.

    A request is over the limit when the one ``max_requests`` places before it
    is still inside the window, so no more times need to be kept, whatever the
    key's traffic. Rejected requests count. Each micro-batch that brings a group
    requests drops the keys whose newest window has ended and moves the timer to
    the end of the last one: a request behind that finds nothing in its window,
    so nothing is lost with the list.
    """

    def __init__(self, window_seconds: int, max_requests: int, carried: list[str]):
        self.span = window_seconds * 1_000_000
        self.limit, self.carried = max_requests, carried

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", T.StructType([T.StructField("rate_key", T.StringType()), T.StructField("us", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["us", "batch_id"], kind="stable")
        recent = pd.DataFrame(list(self.recent.get()), columns=["rate_key", "us"]).astype({"us": "int64"})
        # A key's requests in a row, those of earlier micro-batches first.
        both = pd.concat([recent, frame[["rate_key", "us"]]], ignore_index=True)
        then = both.groupby("rate_key")["us"].shift(self.limit, fill_value=-1)
        limited = (both["us"] - then < self.span) & (both.groupby("rate_key").cumcount() >= self.limit)
        kept = both.groupby("rate_key").tail(self.limit)
        ends = (kept.groupby("rate_key")["us"].transform("max") + self.span) // 1000 + 1
        kept = kept[ends > timer_values.getCurrentWatermarkInMs()]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if len(kept):
            self.recent.put([(k, int(us)) for k, us in zip(kept["rate_key"], kept["us"])])
            self.handle.registerTimer(int(ends.max()))
        else:
            self.recent.clear()
        yield frame[["rate_key", "batch_id", *self.carried]].assign(rate_limited=limited.to_numpy()[len(recent):])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def _flagged(formed: DataFrame, window_seconds: int, max_requests: int, carried: list[str], late: str) -> DataFrame:
    schema = T.StructType([
        T.StructField("rate_key", T.StringType()), T.StructField("batch_id", T.LongType()),
        *[formed.schema[c] for c in carried], T.StructField("rate_limited", T.BooleanType())])
    columns = dict.fromkeys(["rate_key", "batch_id", "received_at", *carried])
    group = F.pmod(F.xxhash64("rate_key"), F.lit(KEY_GROUPS)).alias("_group")
    slim = formed.select(*columns, F.unix_micros("received_at").alias("us"), group).withWatermark("received_at", late)
    return of_kind(slim, "received_at", F.col("rate_key").isNotNull()).groupBy("_group").transformWithStateInPandas(
        statefulProcessor=RateLimiter(window_seconds, max_requests, carried), outputStructType=schema,
        outputMode="append", timeMode="EventTime")


def limited(batches: DataFrame, window_seconds: int = RATE_WINDOW_SECONDS, max_requests: int = RATE_MAX_REQUESTS, late: str = LATE) -> DataFrame:
    """Raw batches that pass the shape checks, with ``rate_limited``. Others never count for a key."""
    return _flagged(formed_batches(batches), window_seconds, max_requests, ["received_at", "user_agent", "body"], late).drop("rate_key")


def rate_flags(batches: DataFrame, window_seconds: int = RATE_WINDOW_SECONDS, max_requests: int = RATE_MAX_REQUESTS, late: str = LATE) -> DataFrame:
    """(rate_key, batch_id, rate_limited) for well-formed batches. Only key, id and time reach the state; a null key only moves the clock."""
    return _flagged(batches, window_seconds, max_requests, [], late)


def formed_batches(batches: DataFrame) -> DataFrame:
    """Batches that pass the shape checks, with their rate key, as they came in."""
    return read_batches(batches).where(F.col("reject_reason").isNull()).select("batch_id", "rate_key", "received_at", "user_agent", "body")
