"""Photos matched to itinerary windows.

Windows start and end on whole minutes of local time; a clock of 24:00 or later
runs on into the next days. A day is cut at the bounds of its windows only, so
n windows make at most 2n + 1 pieces. Which event comes first is the same all
over a piece: it is worked out once, and a photo looks its piece up in the one
row that its day has.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from albumforge.functions.times import local_time
from albumforge.operators.chapters import middle_photo
from albumforge.operators.ordering import with_positions

OTHER = "other_moments"


def window_start(date: Column, clock: Column) -> Column:
    """Local wall-clock time of 'HH:MM' on a date; hours run on past midnight. Null where either can't be read."""
    parts = F.split(clock, ":")
    minutes = F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")
    day = F.try_to_timestamp(date).cast("timestamp_ntz")
    return day + F.make_dt_interval(mins=minutes)


def sweep(events: list[dict]) -> list[dict]:
    """The bounds of a day's events (``_from``, ``_to``, ``event_id``; first ones first), ascending, each with the first event
    at it (``here``) and the first one after it until the next bound (``after``). Events that are open wait in a heap."""
    begins = sorted(range(len(events)), key=lambda i: events[i]["_from"])
    bounds, open_, at, out = sorted({e[c] for e in events for c in ("_from", "_to")}), [], 0, []
    for b in bounds:
        while at < len(begins) and events[begins[at]]["_from"] <= b:
            heapq.heappush(open_, begins[at])
            at += 1
        while open_ and events[open_[0]]["_to"] < b:
            heapq.heappop(open_)
        here = events[open_[0]]["event_id"] if open_ else None
        while open_ and events[open_[0]]["_to"] <= b:
            heapq.heappop(open_)
        out.append({"at": b, "here": here, "after": events[open_[0]]["event_id"] if open_ else None})
    return out


def day_pieces(events: DataFrame, library_id: str = "library_id") -> DataFrame:
    """(library, date) to ``bounds``, ascending: local time, the first event at it, and the first event after it until the next.

    An event of several days counts on each of them, from midnight or to the
    day's end. Events without a usable window, or that end before they start,
    cover nothing. A day has at most 1,441 bounds, as they are whole minutes; its
    events, however many, are swept once.
    """
    timed = events.select(library_id, "ord", "event_id", window_start(F.col("date"), F.col("start_time")).alias("_from"),
                          window_start(F.col("date"), F.col("end_time")).alias("_to")).where("_from <= _to")
    split = timed.withColumn("_date", F.explode(F.sequence(F.to_date("_from"), F.to_date("_to"))))
    midnight = F.col("_date").cast("timestamp_ntz")
    cut = split.select(library_id, "_date", "ord", "event_id", F.greatest("_from", midnight).alias("_from"),
                       F.least("_to", midnight + F.expr("INTERVAL 1 DAY")).alias("_to"))
    whole = cut.groupBy(library_id, "_date").agg(
        F.array_sort(F.collect_list(F.struct("ord", "event_id", "_from", "_to"))).alias("_events"))
    name = events.schema["event_id"].dataType
    bound = T.StructType([T.StructField("at", T.TimestampNTZType()), T.StructField("here", name), T.StructField("after", name)])
    schema = T.StructType([whole.schema[library_id], whole.schema["_date"], T.StructField("bounds", T.ArrayType(bound))])
    arrow = to_arrow_schema(schema)

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = pa.array([sweep(day) for day in batch.column(2).to_pylist()], type=arrow.field("bounds").type)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bounds], schema=arrow)

    return whole.mapInArrow(swept, schema)


def match_events(photos: DataFrame, events: DataFrame, tz: str = "UTC",
                 library_id: str = "library_id") -> DataFrame:
    """Add ``event_id``: the first event whose window holds the photo's time, else 'other_moments'."""
    wall = local_time(F.col("ts"), tz)
    timed = photos.withColumns({"_wall": wall.cast("timestamp_ntz"), "_date": F.to_date(wall)})
    joined = timed.join(day_pieces(events, library_id), [library_id, "_date"], "left")
    before = F.filter("bounds", lambda b: b["at"] <= F.col("_wall"))
    last = F.when(F.size(before) > 0, F.element_at(before, -1))
    found = joined.withColumn("_last", last).withColumn(
        "event_id", F.coalesce(F.when(F.col("_last.at") == F.col("_wall"), F.col("_last.here")).otherwise(F.col("_last.after")), F.lit(OTHER)))
    return found.drop("_date", "_wall", "bounds", "_last")


def place_in_events(matched: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Positions: by time inside an event, by input order among the other moments."""
    by_time = F.when(F.col("event_id") != OTHER, F.col("ts"))
    return with_positions(matched, [library_id, "event_id"],
                          [by_time.asc_nulls_first(), F.col("ordinal").asc()], size="photo_count")


def event_chapters(placed: DataFrame, events: DataFrame, library_id: str = "library_id") -> DataFrame:
    """One chapter per itinerary event, empty ones included, and one for other moments if there are any."""
    counts = placed.groupBy(library_id, "event_id").agg(
        F.count("*").alias("photo_count"), middle_photo(size="photo_count").alias("hero_photo_id"))
    planned = events.join(counts, [library_id, "event_id"], "left").withColumn(
        "photo_count", F.coalesce("photo_count", F.lit(0).cast("bigint")))
    others = counts.where(F.col("event_id") == OTHER).withColumns(
        {"activity": F.lit("Other Moments"), "venue": F.lit("")})
    return planned.unionByName(others, allowMissingColumns=True)


def reorder(placed: DataFrame, new_order: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Replace the positions of chapters for which a valid new order is given.

    ``new_order`` has (library, event_id, photo_id, new_pos). The lead photo of a
    reordered chapter is its new middle one.
    """
    keys = [library_id, "event_id"]
    valid = valid_reorders(placed, new_order, library_id)
    changed = new_order.join(valid, keys, "left_semi")
    moved = placed.drop("pos", "photo_count").join(changed, [*keys, "photo_id"]).withColumnRenamed("new_pos", "pos")
    sizes = changed.groupBy(*keys).agg(F.count("*").alias("photo_count"))
    kept = placed.join(valid, keys, "left_anti")
    return kept.unionByName(moved.join(sizes, keys))


def valid_reorders(placed: DataFrame, new_order: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Chapters whose new order names exactly the same photos, repeats ignored."""
    keys = [library_id, "event_id"]
    old = placed.select(*keys, "photo_id", F.lit(1).alias("_old"), F.lit(0).alias("_new"))
    new = new_order.select(*keys, "photo_id", F.lit(0).alias("_old"), F.lit(1).alias("_new"))
    sides = old.unionByName(new).groupBy(*keys, "photo_id").agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    return sides.groupBy(*keys).agg(
        F.sum("_new").alias("_asked"), F.count_if(F.col("_old") != F.col("_new")).alias("_bad")
    ).where((F.col("_asked") > 0) & (F.col("_bad") == 0)).select(*keys)
