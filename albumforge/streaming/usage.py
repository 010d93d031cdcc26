"""Usage streams: daily metrics, first completions, and replayed choices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from albumforge.operators import metrics as m
from albumforge.streaming.completion import of_kind

# Metric name to (event name, extra grouping, aggregates). Percentiles: see ``day_sketches``.
DAILY = {
    "uploads": (m.PHOTOS_UPLOADED, lambda: [], m.uploads),
    "toggles": (m.TOGGLE_COUNT, lambda: [], m.toggles),
    "funnel": (m.CURATION_FUNNEL, lambda: [], m.funnel),
    "bail_outs": (m.BAIL_OUT, m.bail_out_keys, lambda: [F.count("*").alias("bail_outs")]),
    "errors": (m.ERROR, m.error_keys, lambda: [F.count("*").alias("errors")]),
}


def daily_metric(events: DataFrame, metric: str, late: str | None = None) -> DataFrame:
    """In update mode, each day so far, whenever it changes; rows of any age count.

    With ``late``, one row per closed day in append mode, and rows that come
    later than that are lost.
    """
    name, keys, aggregates = DAILY[metric]
    windowed = m.named(events, name)
    if late is not None:
        windowed = windowed.withWatermark("server_ts", late)
    grouping: list[Column] = [F.window("server_ts", "1 day").alias("_w"), *keys()]
    out = windowed.groupBy(*grouping).agg(*aggregates())
    return out.withColumn("day", F.col("_w.start")).drop("_w")


# Metric name to event name, and whether each property is a stage of its own.
TIMED = {
    "time_to_curation": (m.TIME_TO_CURATION, False),
    "curation_duration": (m.CURATION_DURATION, False),
    "stage_durations": (m.STAGE_DURATION, True),
}
# Size of a quantile sketch: a percentile's rank is off by less than RANK_ERROR of the samples, in 99 of 100 sketches.
SKETCH_SIZE, RANK_ERROR = 800, 0.005


def timing_values(events: DataFrame, metric: str) -> DataFrame:
    """server_ts, stage (null unless the metric has stages) and ms of every sample; batch or stream."""
    name, staged = TIMED[metric]
    # In a stream, other events move the clock too.
    rows = of_kind(events, "server_ts", F.col("event_name") == name) if events.isStreaming else m.named(events, name)
    if staged:
        rows = rows.select("server_ts", F.explode(F.from_json("properties", "map<string,string>")).alias("stage", "_ms"))
    else:
        rows = rows.select("server_ts", F.lit(None).cast("string").alias("stage"), m.text("ms").alias("_ms"))
    return rows.select("server_ts", "stage", F.col("_ms").cast("decimal(20,6)").alias("ms"))


def day_sketches(values: DataFrame, size: int = SKETCH_SIZE) -> DataFrame:
    """Per day and stage: samples, how many have a value, their sum, and a mergeable quantile sketch.

    In update mode, each day whenever it changes. The state of a day is a few
    kilobytes, however many samples it has, and goes when the watermark of
    ``values`` passes the day.
    """
    grouped = values.groupBy(F.window("server_ts", "1 day").alias("_w"), "stage").agg(
        F.count("*").alias("samples"), F.count("ms").alias("n"), F.sum("ms").alias("total"),
        F.kll_sketch_agg_double(F.col("ms").cast("double"), size).alias("sketch"))
    return grouped.withColumn("day", F.col("_w.start")).drop("_w")


def sketched_timings(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of ``metrics.timing`` from sketches, merged over ``keys``: counts and mean are exact, a percentile is a sample whose rank is within RANK_ERROR of it."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("samples").alias("samples"), F.sum("n").alias("n"), F.sum("total").alias("_total"),
        F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("sketch"))).alias("_sketch"))

    def percentile(p: float) -> Column:
        return F.when(F.col("n") > 0, F.rint(F.kll_sketch_get_quantile_double("_sketch", F.lit(p))))

    return merged.select(*keys, "samples", F.round(F.col("_total") / F.nullif("n", F.lit(0)), 0).alias("avg_ms"),
                         percentile(0.5).alias("p50_ms"), percentile(0.95).alias("p95_ms"))


def timings_now(sketches: DataFrame, values: DataFrame, closed_before: Column) -> DataFrame:
    """Daily timings as of now: exact from the stored ``values`` for days that end before ``closed_before``, else from the sketches.

    ``values`` has the column ``day``, which it is stored by, so open days aren't read.
    """
    ended = lambda day: F.col(day) + F.expr("INTERVAL 1 DAY") <= closed_before
    closed = m.timing(values.where(ended("day")).withColumn("day", F.col("day").cast("timestamp")), ["day"], F.col("ms"))
    return closed.unionByName(sketched_timings(sketches.where(~ended("day")), ["day"]))


class ChoiceReplay(StatefulProcessor):
    """Per (library, photo): whether it is kept, and how often it was pressed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", T.StructType([
            T.StructField("kept", T.BooleanType()), T.StructField("presses", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        state = self.state.get()
        kept, presses = (bool(state[0]), int(state[1])) if state is not None else (False, 0)
        for action in frame["action"]:
            if action == "start":
                kept = True
                continue
            kept = {"on": True, "off": False}.get(action, not kept)
            presses += 1
        self.state.update((kept, presses))
        yield pd.DataFrame({"library_id": [key[0]], "photo_id": [key[1]], "kept": [kept], "presses": [presses]})

    def close(self) -> None:
        pass


def replay(actions: DataFrame) -> DataFrame:
    """State of every photo touched in a micro-batch. Starters come in as action 'start' before their presses."""
    ids = T.StructType([
        T.StructField("library_id", actions.schema["library_id"].dataType),
        T.StructField("photo_id", actions.schema["photo_id"].dataType),
        T.StructField("kept", T.BooleanType()), T.StructField("presses", T.LongType())])
    return actions.select("library_id", "photo_id", "seq", "action").groupBy(
        "library_id", "photo_id").transformWithStateInPandas(
        statefulProcessor=ChoiceReplay(), outputStructType=ids, outputMode="update", timeMode="None")
