"""Finished curations and bail-outs while events come in: tables by micro-batch, or stream-stream joins with bounds on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from albumforge.operators.completion import reports
from albumforge.session import cut_lineage
from albumforge.streaming.running import record_first


def of_kind(timed: DataFrame, time: str, condition: Column) -> DataFrame:
    """Rows of one kind out of a stream with a watermark on ``time``.

    The condition reads the time too, so it isn't moved ahead of the watermark:
    rows of other kinds still move the clock.
    """
    return timed.where(F.when(condition, F.col(time)).isNotNull())


def finished_sessions(finishes: DataFrame, presses: DataFrame, longest: str = "1 day", library_id: str = "library_id") -> DataFrame:
    """Each finish with the presses of its session up to then: ``presses`` and ``distinct_photos``, 0 where there are none.

    ``finishes``: library, ``session_id``, ``finished_at``, ``started_at``;
    ``presses``: ``session_id``, ``photo_id``, ``pressed_at``; both with a
    watermark on their time. A session lasts ``longest`` at most: earlier presses
    don't count, so either side's state goes once the other's clock has passed
    it. Photos are counted one by one first, so a busy session is many keys. A
    finish comes out when the watermark passes it. Every finish meets its presses:
    where only the first one reports, ``record_usage`` does less.
    """
    once = finishes.dropDuplicates([library_id, "session_id", "finished_at"])
    pressed = presses.select(F.col("session_id").alias("_session"), "photo_id", "pressed_at")
    during = (F.col("session_id") == F.col("_session")) & (F.col("pressed_at") <= F.col("finished_at")) & (
        F.col("pressed_at") >= F.col("finished_at") - F.expr(f"INTERVAL {longest}"))
    keys = [library_id, "session_id", "finished_at", "started_at"]
    # One event time goes on: that of the finish.
    met = once.join(pressed, during, "leftOuter").select(*keys, "photo_id", F.col("pressed_at").isNotNull().cast("bigint").alias("_pressed"))
    by_photo = met.groupBy(*keys, "photo_id").agg(F.sum("_pressed").alias("_n"))
    return by_photo.groupBy(*keys).agg(F.sum("_n").alias("presses"), F.count(F.when(F.col("_n") > 0, F.col("photo_id"))).alias("distinct_photos"))


def record_completions(finished: DataFrame, facts: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                       library_id: str = "library_id") -> StreamingQuery:
    """Completion events of each session's first finish, written under ``path``; a later finish reports nothing, however late.
    """
    return record_first(finished, [library_id, "session_id"], "finished_at", path, checkpoint, available_now,
                        lambda first: reports(first, facts, library_id))


def record_usage(usage: DataFrame, started: DataFrame, facts: DataFrame, path: str, checkpoint: str, longest: str = "1 day", late: str = "1 day",
                 available_now: bool = False, library_id: str = "library_id") -> StreamingQuery:
    """Completion events of each session's first finish, under ``path``/table, from presses and finishes as they come in.

    ``usage``: library, ``session_id``, ``kind`` (press, finish; other kinds only
    move the clock), ``photo_id``, ``at``. ``started``: ``session_id``,
    ``started_at``. Presses up to ``longest`` before the finish count. A finish
    comes out when the newest row is ``late`` past it, and meets the presses of
    its session only if it is the first: the work grows with the presses, however
    often a session finishes. Rows are kept in a table by micro-batch and day, so
    there is no state; the days that a finish can't reach aren't read. A
    micro-batch that is repeated replaces its folders.
    """
    keys = [library_id, "session_id"]
    known = F.col("kind").isin("press", "finish")

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.where(known).withColumn("day", F.to_date("at")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/usage/batch_no={number}")
        batch.agg((F.max("at") - F.expr(f"INTERVAL {late}")).alias("clock")).write.mode("overwrite").parquet(f"{path}/clock/batch_no={number}")
        clocks = spark.read.schema("clock timestamp, batch_no int").parquet(f"{path}/clock").where(F.col("batch_no") <= number)
        # The clock now, and as it was before.
        before = F.max(F.when(F.col("batch_no") < number, F.col("clock")))
        now, then = (None if us is None else F.timestamp_micros(F.lit(us)) for us in clocks.agg(F.unix_micros(F.max("clock")), F.unix_micros(before)).first())
        if now is None:
            now = F.lit(None).cast("timestamp")
        kinds = T.StructType([*[batch.schema[c] for c in (*keys, "kind", "photo_id", "at")], T.StructField("day", T.DateType()), T.StructField("batch_no", T.IntegerType())])
        rows = spark.read.schema(kinds).parquet(f"{path}/usage").where(F.col("batch_no") <= number)
        due = rows.where((F.col("kind") == "finish") & (F.col("at") <= now))
        if then is not None:
            # Finishes up to the clock before have come out, but for those that come late.
            due = due.where((F.col("batch_no") == number) | ((F.col("day") >= F.to_date(then)) & (F.col("at") > then)))
        first = due.groupBy(*keys).agg(F.min("at").alias("finished_at"))
        if number:
            told = T.StructType([*[batch.schema[k] for k in keys], T.StructField("batch_no", T.IntegerType())])
            done = spark.read.schema(told).parquet(f"{path}/table").where(F.col("batch_no") < number)
            first = first.join(done.select(*keys), keys, "left_anti")
        first = cut_lineage(first)
        back = F.expr(f"INTERVAL {longest}")
        earliest = F.timestamp_micros(F.lit(first.agg(F.unix_micros(F.min("finished_at"))).first()[0]).cast("bigint")) - back
        pressed = rows.where((F.col("kind") == "press") & (F.col("day") >= F.to_date(earliest)) & (F.col("at") <= now)).select("session_id", "photo_id", "at")
        met = pressed.join(first, "session_id").where((F.col("at") <= F.col("finished_at")) & (F.col("at") >= F.col("finished_at") - back))
        # Photos are counted one by one first, so a busy session is many keys.
        by_photo = met.groupBy(*keys, "photo_id").agg(F.count("*").alias("_n"))
        counts = by_photo.groupBy(*keys).agg(F.sum("_n").alias("presses"), F.count("photo_id").alias("distinct_photos"))
        finished = first.join(counts, keys, "left").join(started, "session_id", "left")
        reports(finished, facts, library_id).write.mode("overwrite").parquet(f"{path}/table/batch_no={number}")

    writer = usage.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def bail_outs(leaves: DataFrame, finishes: DataFrame, longest: str = "1 day") -> DataFrame:
    """Leaving by Back at once; a closed tab when the watermark proves that no finish of its session came before.

    ``leaves``: ``session_id``, ``kind``, ``left_at``; ``finishes``: ``session_id``,
    ``finished_at``; both with a watermark. A finish more than ``longest`` before
    doesn't count: it was another session's.
    """
    done = finishes.select(F.col("session_id").alias("_session"), "finished_at")
    before = (F.col("session_id") == F.col("_session")) & (F.col("finished_at") <= F.col("left_at")) & (
        F.col("finished_at") >= F.col("left_at") - F.expr(f"INTERVAL {longest}"))
    closed = of_kind(leaves, "left_at", F.col("kind") == "tab_close").join(done, before, "leftOuter").where("_session IS NULL")
    return of_kind(leaves, "left_at", F.col("kind") == "back").unionByName(closed.select(*leaves.columns))
