"""Usage metrics over the event table.

The table has ``event_name``, ``properties`` (JSON text) and ``server_ts``. Sums
and means are exact decimals. Percentiles interpolate between two exact order
statistics, which ``rank_values`` finds from value counts, so a busy day or a
stage present in every run never lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumforge.operators.ordering import rank_values

# Milliseconds per histogram bucket when a percentile is looked up.
MS_BUCKET = 1000.0
# Event names.
PHOTOS_UPLOADED = "photos_uploaded"
TIME_TO_CURATION = "time_to_curation"
CURATION_DURATION = "curation_duration"
TOGGLE_COUNT = "toggle_count"
CURATION_FUNNEL = "curation_funnel"
STAGE_DURATION = "pipeline_stage_duration"
BAIL_OUT = "bail_out"
ERROR = "error"
QUALITY_ERRORS = "curation_quality_errors"
# Confusion cells, and the quality buckets with their midpoints.
CELLS = ("tp", "fp", "fn", "tn")
BUCKETS = ("[0.00,0.25)", "[0.25,0.50)", "[0.50,0.75)", "[0.75,1.00]")
MIDPOINTS = ("0.125", "0.375", "0.625", "0.875")


def text(key: str) -> Column:
    return F.get_json_object("properties", f"$.{key}")


def whole(key: str) -> Column:
    return text(key).cast("int")


def number(key: str) -> Column:
    return text(key).cast("decimal(20,6)")


def day_of(ts: str = "server_ts") -> Column:
    return F.date_trunc("day", F.col(ts)).alias("day")


def named(events: DataFrame, name: str) -> DataFrame:
    """Events of one name. Store the table by day and sorted by name, and files are skipped."""
    return events.where(F.col("event_name") == name)


def uploads() -> list[Column]:
    return [
        F.count("*").alias("upload_events"),
        F.sum(whole("count")).alias("total_photos"),
        F.round(F.avg(number("count")), 1).alias("avg_photos_per_upload"),
    ]


def uploads_by_day(events: DataFrame) -> DataFrame:
    return named(events, PHOTOS_UPLOADED).groupBy(day_of()).agg(*uploads())


def timing(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Samples, rounded mean, p50 and p95 of a timing."""
    keys = list(keys)
    timed = rows.select(*keys, value.cast("decimal(20,6)").alias("ms"))
    base = timed.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.count("ms").alias("_n"), F.round(F.avg("ms"), 0).alias("avg_ms"))
    spots = {}
    for name, p in (("p50", 0.5), ("p95", 0.95)):
        at = (F.col("n") - 1) * F.lit(p)
        spots[f"{name}_lo"], spots[f"{name}_hi"] = F.floor(at), F.ceil(at)
    found = rank_values(timed.withColumn("ms", F.col("ms").cast("double")), keys, "ms", spots, MS_BUCKET)
    out = base.join(found, keys, "left")
    for name, p in (("p50", 0.5), ("p95", 0.95)):
        at = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        # A rounded double goes to the even neighbour on a tie.
        out = out.withColumn(f"{name}_ms", F.rint(lo + (hi - lo) * (at - F.floor(at))))
    return out.select(*keys, "samples", "avg_ms", "p50_ms", "p95_ms")


def timing_by_day(events: DataFrame, event_name: str) -> DataFrame:
    """Daily timing of an event that carries ``ms``."""
    return timing(named(events, event_name).withColumn("day", day_of()), ["day"], text("ms"))


def stage_durations(events: DataFrame) -> DataFrame:
    """Timing per stage; every property key of the event is a stage."""
    stages = named(events, STAGE_DURATION).select(
        F.explode(F.from_json("properties", "map<string,string>")).alias("stage", "value"))
    return timing(stages, ["stage"], F.col("value"))


def toggles() -> list[Column]:
    return [
        F.count("*").alias("sessions"),
        F.round(F.avg(number("presses")), 1).alias("avg_presses"),
        F.round(F.avg(number("distinctPhotos")), 1).alias("avg_distinct_photos"),
    ]


def toggles_by_day(events: DataFrame) -> DataFrame:
    return named(events, TOGGLE_COUNT).groupBy(day_of()).agg(*toggles())


def funnel() -> list[Column]:
    """Stage sums, and means of the per-session ratios (not ratios of the sums)."""
    zero = F.lit(0).cast("decimal(20,6)")
    ratio = lambda a, b: F.avg(number(a) / F.nullif(number(b), zero))
    return [
        F.count("*").alias("sessions"),
        F.sum(whole("uploaded")).alias("uploaded"),
        F.sum(whole("autoKept")).alias("auto_kept"),
        F.sum(whole("userKept")).alias("user_kept"),
        F.round(ratio("userKept", "autoKept"), 2).alias("user_vs_auto"),
        F.round(ratio("userKept", "uploaded"), 3).alias("keep_rate"),
    ]


def funnel_by_day(events: DataFrame) -> DataFrame:
    return named(events, CURATION_FUNNEL).groupBy(day_of()).agg(*funnel())


def bail_out_keys() -> list[Column]:
    return [text("from").alias("bail_from")]


def bail_outs_by_day(events: DataFrame) -> DataFrame:
    return named(events, BAIL_OUT).groupBy(day_of(), *bail_out_keys()).agg(F.count("*").alias("bail_outs"))


def error_keys() -> list[Column]:
    return [text("source").alias("source"), F.coalesce(text("name"), text("failed")).alias("detail")]


def errors_by_day(events: DataFrame) -> DataFrame:
    return named(events, ERROR).groupBy(day_of(), *error_keys()).agg(F.count("*").alias("errors"))


def quality_errors_by_day(events: DataFrame) -> DataFrame:
    """Precision, recall and mean quality per confusion cell, from bucket counts."""
    aggs = [F.count("*").alias("sessions")]
    for cell in CELLS:
        counts = [whole(f"{cell}_q{i}") for i in range(4)]
        weighted = [c * F.lit(m).cast("decimal(4,3)") for c, m in zip(counts, MIDPOINTS)]
        # One missing bucket makes the session's term null, and the sum skips it.
        aggs.append(F.sum(counts[0] + counts[1] + counts[2] + counts[3]).alias(cell))
        aggs.append(F.sum(weighted[0] + weighted[1] + weighted[2] + weighted[3]).alias(f"{cell}_qsum"))
    aggs.append(F.sum(F.coalesce(whole("nullQuality"), F.lit(0))).alias("null_quality"))
    share = lambda a, b: F.round(
        F.col(a).cast("decimal(20,3)") / F.nullif(b, F.lit(0).cast("bigint")).cast("decimal(20,0)"), 3)
    return named(events, QUALITY_ERRORS).groupBy(day_of()).agg(*aggs).select(
        "day", "sessions", *CELLS, "null_quality",
        share("tp", F.col("tp") + F.col("fp")).alias("precision"),
        share("tp", F.col("tp") + F.col("fn")).alias("recall"),
        *[share(f"{c}_qsum", F.col(c)).alias(f"{c}_mean_quality") for c in CELLS],
    )


def quality_error_buckets(events: DataFrame) -> DataFrame:
    """Eight rows, always: the two error histograms in long form, from one pass."""
    picks = [(cell, i) for cell in ("fp", "fn") for i in range(4)]
    sums = named(events, QUALITY_ERRORS).agg(
        *[F.coalesce(F.sum(whole(f"{c}_q{i}")), F.lit(0)).alias(f"{c}{i}") for c, i in picks])
    args = [x for c, i in picks for x in (F.lit(c), F.lit(BUCKETS[i]), F.col(f"{c}{i}"))]
    return sums.select(F.stack(F.lit(len(picks)), *args).alias("cell", "bucket", "n"))


def stage_run_map(timings: DataFrame, run: str, stage: str = "stage", ms: str = "ms",
                  seq: str = "seq") -> DataFrame:
    """One JSON object {stage: ms} per run, in stage order. A run has a handful of stages."""
    entries = F.array_sort(F.collect_list(F.struct(seq, stage, ms)))
    pairs = F.transform(entries, lambda e: F.struct(e[stage], e[ms]))
    return timings.groupBy(run).agg(F.to_json(F.map_from_entries(pairs)).alias("properties"))


def view_order(metric: DataFrame, *newest_first: str) -> DataFrame:
    """Display order of the metric views: descending, nulls first."""
    return metric.orderBy(*[F.col(c).desc_nulls_first() for c in newest_first])
