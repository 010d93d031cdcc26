"""Itinerary documents: nested events per trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "struct<id:string,date:string,activity:string,venue:string,start_time:string,end_time:string>"
SCHEMA = f"trip_name string, events array<{EVENT}>"


def read_itineraries(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one per file, as rows of (path, body)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def itinerary_events(docs: DataFrame, library_id: str = "library_id") -> DataFrame:
    """One row per event with ``ord``, its place in the document."""
    parsed = docs.withColumn("_doc", F.from_json("body", SCHEMA))
    return parsed.select(
        library_id, F.col("_doc.trip_name").alias("trip_name"),
        F.posexplode("_doc.events").alias("ord", "_e"),
    ).select(library_id, "trip_name", "ord", F.col("_e.id").alias("event_id"), "_e.date", "_e.activity",
             "_e.venue", "_e.start_time", "_e.end_time")


def itinerary_problems(docs: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Documents without an event list, and events that lack id, date, start or end."""
    parsed = docs.withColumn("_doc", F.from_json("body", SCHEMA))
    no_list = parsed.where(F.col("_doc.events").isNull()).select(
        library_id, F.lit(None).cast("int").alias("ord"), F.lit("no event list").alias("problem"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    events = itinerary_events(docs, library_id)
    lacking = events.where(blank("event_id") | blank("date") | blank("start_time") | blank("end_time"))
    return no_list.unionByName(lacking.select(library_id, "ord", F.lit("missing field").alias("problem")))
