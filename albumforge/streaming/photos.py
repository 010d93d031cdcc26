"""Photo streams: sessions by gap, and near duplicates as pictures come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from albumforge.operators.dedup import HAMMING_THRESHOLD, WINDOW, RecentKept
from albumforge.operators.dedup import near_duplicates as batch_walk


def photo_sessions(photos: DataFrame, gap_minutes: int = 45, late: str | None = None,
                   library_id: str = "library_id") -> DataFrame:
    """Sessions per library: first and last photo time and the photo count.

    In complete mode all sessions, open ones included, whatever their rows' age.
    With ``late``, closed sessions in append mode; rows that come later are lost.

    A gap of exactly the limit still joins, one microsecond more splits: a session
    window merges while the next event is before its end, so its length is the
    gap and one microsecond. Sessions are merged inside each input partition
    first, so a busy library sends few rows.
    """
    photos.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    length = f"{gap_minutes} minutes 1 microsecond"
    dated = photos.where(F.col("ts").isNotNull())
    if late is not None:
        dated = dated.withWatermark("ts", late)
    grouped = dated.groupBy(library_id, F.session_window("ts", length).alias("_w")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("photos"))
    return grouped.drop("_w")


class NearDuplicateWalk(StatefulProcessor):
    """Per library, the last kept fingerprints. Hashes travel as text, which pandas keeps exact beside nulls."""

    def __init__(self, threshold: int, window: int):
        self.threshold, self.window = threshold, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", T.StructType([
            T.StructField("hashes", T.ArrayType(T.StringType())), T.StructField("ids", T.ArrayType(T.StringType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("name_no", kind="stable")
        state = self.kept.get()
        entries = [] if state is None else [
            (None if h is None else int(h), i) for h, i in zip(state[0], state[1])]
        recent = RecentKept(entries, self.threshold, self.window)
        found = [recent.visit(i, None if h is None else int(h)) for i, h in zip(frame["photo_id"], frame["hash"])]
        self.kept.update(([None if h is None else str(h) for h, _ in recent.entries], [i for _, i in recent.entries]))
        out = pd.DataFrame(found, columns=["status", "rep_id", "distance", "nearest_distance"])
        out.insert(0, "photo_id", frame["photo_id"].values)
        out.insert(0, "library_id", [str(key[0])] * len(frame))
        for c in ("distance", "nearest_distance"):
            out[c] = out[c].astype("Int64")
        yield out

    def close(self) -> None:
        pass


def near_duplicates(photos: DataFrame, threshold: int = HAMMING_THRESHOLD, window: int = WINDOW,
                    library_id: str = "library_id") -> DataFrame:
    """Status of each photo as it arrives.

    Photos of a library must arrive in name order, given as the number
    ``name_no``; inside a micro-batch they are sorted. A photo that comes too
    late is compared with what is kept by then, which is where this differs from
    the batch result. A library is one state key, so the size of a micro-batch
    bounds the work of a busy one.
    """
    slim = photos.select(F.col(library_id).cast("string").alias("library_id"), "photo_id", "name_no",
                         F.col("hash").cast("string").alias("hash"))
    schema = "library_id string, photo_id string, status string, rep_id string, distance int, nearest_distance int"
    return slim.groupBy("library_id").transformWithStateInPandas(
        statefulProcessor=NearDuplicateWalk(threshold, window), outputStructType=schema, outputMode="append", timeMode="None")


# Micro-batches after which the kept photos of all libraries are written together again.
GATHER = 32


def record_near_duplicates(photos: DataFrame, path: str, checkpoint: str, threshold: int = HAMMING_THRESHOLD, window: int = WINDOW,
                           available_now: bool = False, library_id: str = "library_id", partitions: int | None = None) -> StreamingQuery:
    """The same walk with no library in one task: each micro-batch is walked in pieces, from where the one before ended.

    The state is a table, ``window`` photos of each library that came: the last
    ones kept. They go ahead of the library's new photos, where they are kept
    again, since they were compared with more before. Then the batch walk takes
    over, which cuts a busy library over many tasks. ``name_no`` (0 and up) is the
    order inside a library. A micro-batch that is repeated replaces its folders.
    """
    by_library = Window.partitionBy(library_id).orderBy(F.col("visit").desc())

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(library_id, "photo_id", "hash", F.col("name_no").cast("bigint").alias("ordinal"))
        rows = new
        recent = None
        if number:
            state = T.StructType([new.schema[library_id], new.schema["photo_id"], new.schema["hash"], T.StructField("visit", T.LongType()), T.StructField("batch_no", T.IntegerType())])
            recent = spark.read.schema(state).parquet(f"{path}/recent").where((F.col("batch_no") < number) & (F.col("batch_no") >= (number - 1) // GATHER * GATHER))
            newest = recent.groupBy(library_id).agg(F.max("batch_no").alias("batch_no"))
            recent = recent.join(newest, [library_id, "batch_no"])
            touched = recent.join(new.select(library_id).distinct(), library_id, "left_semi")
            ahead = (-F.row_number().over(by_library)).cast("bigint")
            rows = touched.select(library_id, "photo_id", "hash", ahead.alias("ordinal")).unionByName(new)
        walked = batch_walk(rows.withColumn("name", F.lit("")), threshold, window, library_id, partitions)
        out = f"{path}/walked/batch_no={number}"
        walked.write.mode("overwrite").parquet(out)
        done = spark.read.schema(walked.schema).parquet(out).where("status = 'kept'")
        last = done.withColumn("_no", F.row_number().over(by_library)).where(F.col("_no") <= window)
        kept = last.join(rows.select(library_id, "photo_id", "hash"), [library_id, "photo_id"]).select(library_id, "photo_id", "hash", "visit")
        if number % GATHER == 0 and recent is not None:
            kept = kept.unionByName(recent.join(new.select(library_id).distinct(), library_id, "left_anti").select(*kept.columns))
        kept.write.mode("overwrite").parquet(f"{path}/recent/batch_no={number}")

    writer = photos.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def recorded_near_duplicates(spark: SparkSession, path: str) -> DataFrame:
    """Every photo that has come in, with its status; photos that only went ahead of a later micro-batch are left out."""
    return spark.read.parquet(f"{path}/walked").where("ordinal >= 0").drop("visit")
