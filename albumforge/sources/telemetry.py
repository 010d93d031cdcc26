"""Event batches as a stream, and the event table they end in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_SCHEMA = "batch_id bigint, received_at timestamp, user_agent string, body string"


def batch_stream(spark: SparkSession, path: str, files_per_trigger: int = 200) -> DataFrame:
    """Request batches as files land; the body stays text until it is checked."""
    return (
        spark.readStream.schema(BATCH_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)
    )


def read_events(spark: SparkSession, path: str, event_name: str | None = None) -> DataFrame:
    """The event table. It is stored by day and sorted by name, so both filters skip files."""
    events = spark.read.parquet(path)
    return events if event_name is None else events.where(F.col("event_name") == event_name)


def settle_events(arrived: DataFrame, path: str) -> None:
    """Events in their lasting form under ``path``: by day, and inside a day clustered by name and time, properties as VARIANT.

    A day is replaced whole, so settling it again, or after rows came late,
    leaves it right; other days are not touched. Ranges of (day, name, time) are
    files of their own, whose statistics let a reader of one name or time skip
    the rest. ``arrived`` has all rows of the days in it.
    """
    rows = arrived.withColumns({"properties": F.try_parse_json("properties"), "day": F.to_date("server_ts")})
    laid = rows.repartitionByRange("day", "event_name", "server_ts").sortWithinPartitions("day", "event_name", "server_ts")
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def settled_events(spark: SparkSession, path: str, event_name: str | None = None) -> DataFrame:
    """Settled events, with their properties as JSON text again, as the metrics read them."""
    events = read_events(spark, path, event_name)
    return events.withColumn("properties", F.to_json("properties"))
