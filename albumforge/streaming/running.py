"""Starting streams: state store settings, sinks, and draining a bounded source."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from albumforge.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State lives on disk, not on the heap, and is required by the stateful processors here."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def append_events(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Event rows to the event table, by day, with a row id and the server's own time.

    The file sink commits each micro-batch once, so a restart neither loses nor
    repeats rows.
    """
    stamped = rows.withColumns({
        "id": F.expr("uuid()"),
        "server_ts": F.current_timestamp() if "server_ts" not in rows.columns else F.col("server_ts"),
    }).withColumn("day", F.to_date("server_ts"))
    writer = stamped.writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def append_values(values: DataFrame, path: str, checkpoint: str, available_now: bool = False, time: str = "server_ts") -> StreamingQuery:
    """Rows of a stream stored by the day of ``time``, each micro-batch once."""
    writer = values.withColumn("day", F.to_date(time)).writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def watermark_of(query: StreamingQuery) -> Column:
    """The watermark that the last micro-batch ran with."""
    return F.to_timestamp(F.lit(query.recentProgress[-1]["eventTime"]["watermark"]))


def drain(stream: DataFrame, output_mode: str = "append", finished: list[StreamingQuery] | None = None) -> DataFrame:
    """Run a stream over what its source holds now and return everything it emitted.

    In update mode every emission is kept with its micro-batch number ``batch_no``.
    The query that has run is added to ``finished``.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/albumforge-stream-{uuid.uuid4().hex}"
    out, checkpoint = f"{base}/out", f"{base}/checkpoint"
    if output_mode == "append":
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start(out)
        schema = stream.schema
    else:
        def keep(batch: DataFrame, number: int) -> None:
            # Overwriting the batch's own folder keeps a repeated micro-batch from counting twice.
            batch.write.mode("overwrite").parquet(f"{out}/batch_no={number}")

        query = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(
            keep).trigger(availableNow=True).start()
        schema = T.StructType([*stream.schema.fields, T.StructField("batch_no", T.IntegerType())])
    query.awaitTermination()
    if finished is not None:
        finished.append(query)
    return spark.read.schema(schema).parquet(out)


def files_for(rows: DataFrame, rows_per_file: int = 500_000, slices: int = 3, least: int = 4) -> int:
    """Files of a slice, so that none holds many more than ``rows_per_file`` rows: a slice is written and read by as many tasks as it needs."""
    return max(least, math.ceil(rows.count() / slices / rows_per_file))


def write_slices(rows: DataFrame, time: str, path: str, slices: int = 3, files: int = 4, form: str = "parquet", closing: DataFrame | None = None) -> None:
    """``rows`` under ``path`` as they would have come in: one time slice after the other, each in ``files`` files.

    ``closing`` comes last: a row that only moves the clock on, in a slice of its
    own, and one more, as a watermark takes effect in the micro-batch behind it.
    For runs over a table at rest; a live source brings its own files.
    """
    bounds = rows.agg(F.percentile_approx(time, [k / slices for k in range(1, slices)], 10_000)).first()[0] or []
    at = F.lit(0)
    for b in bounds:
        at = at + (F.col(time) > F.lit(b)).cast("int")
    for k in range(slices):
        rows.where(F.coalesce(at, F.lit(0)) == k).repartition(files).write.mode("append").format(form).save(path)
    if closing is not None:
        for copies in (files, 1):
            each = closing.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).repartitionByRange(copies, "_copy")
            each.drop("_copy").write.mode("append").format(form).save(path)


def slice_stream(spark: SparkSession, schema: T.StructType, path: str, files: int = 4) -> DataFrame:
    """What ``write_slices`` wrote as Parquet, a slice for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def record_first(rows: DataFrame, keys: list[str], order: str, path: str, checkpoint: str, available_now: bool = False,
                 told: Callable[[DataFrame], DataFrame] = lambda first: first) -> StreamingQuery:
    """The first row of each key, by ``order``, written under ``path`` as ``told`` has it; a later one never is, however late.

    What was written is looked up in the table itself, so no state has to
    remember a key for ever; ``told`` keeps the key columns. Each micro-batch
    owns a folder: one that is repeated replaces what it wrote.
    """
    rest = [c for c in rows.columns if c not in (*keys, order)]

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_f")).select(*keys, "_f.*")
        if number:
            done = spark.read.schema(T.StructType([*[first.schema[k] for k in keys], T.StructField("batch_no", T.IntegerType())])).parquet(path)
            first = first.join(done.where(F.col("batch_no") < number).select(*keys).distinct(), keys, "left_anti")
        told(first).write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last emission of each key from a stream drained in update mode; null keys are keys too."""
    values = [c for c in updates.columns if c not in (*keys, "batch_no")]
    last = F.max_by(F.struct(*values), "batch_no").alias("_last")
    return updates.groupBy(*keys).agg(last).select(*keys, "_last.*")


def last_state(updates: DataFrame) -> DataFrame:
    """The result as it stood after the last micro-batch, from a stream drained in complete mode."""
    newest = updates.agg(F.max("batch_no").alias("_newest"))
    return updates.join(F.broadcast(newest), F.col("batch_no") == F.col("_newest")).drop("batch_no", "_newest")
