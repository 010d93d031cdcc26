"""Reading tables, cutting plans with written tables, and running numbers, for the operators here."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.session import shared_dir

#: The six white-space bytes of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
_OPS = {"add": np.add, "xor": np.bitwise_xor}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table of its own in the shared folder: cuts lineage, and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/llm/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_fold(id_column: Column, parts: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % parts == fold


def clashing(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with just these columns; other columns, whatever their names, can't clash with working columns."""
    return df.select(*[df[n] for n in names])


def numbered(df: DataFrame, order: list[str], value: str, total: str, tag: str) -> DataFrame:
    """``df`` with ``total``: the sum of ``value`` over all rows that come before in ``order``.

    Rows are dealt by ranges of ``order``, so no task sees them all; the driver
    gets one sum per task.
    """
    spark = df.sparkSession
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), tag)
    sums = sorted((r["_part"], r["s"] or 0) for r in dealt.groupBy("_part").agg(F.sum(value).alias("s")).collect())
    before, at = [], 0
    for part, s in sums:
        before.append((part, at))
        at += s
    base = spark.createDataFrame(before or [(0, 0)], "_part int, _base long")
    own = F.expr(f"sum({value}) OVER (PARTITION BY _part ORDER BY {', '.join(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return (dealt.withColumn("_own", F.coalesce(own, F.lit(0))).join(F.broadcast(base), "_part")
            .withColumn(total, F.col("_base") + F.col("_own")).drop("_base", "_own", "_part"))


def scanned(df: DataFrame, key: str, order: list[str], values: dict[str, str], tag: str) -> DataFrame:
    """``df`` with each of ``values`` (long column: "add", "xor" or "first") running over the rows of ``key`` up to the row itself, in ``order``.

    Rows are dealt by ranges, so a key with very many rows is cut over tasks;
    the driver sees one row for each task.
    """
    spark = df.sparkSession
    fields = df.dtypes
    at = {name: i for i, (name, _) in enumerate(fields)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(at[key]).to_numpy()
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            size = np.diff(np.append(starts, len(own)))
            goes_on = last is not None and own[0] == last
            out = []
            for name, op in values.items():
                v = batch.column(at[name]).to_numpy().copy()
                if op == "first":
                    begin = v[starts]
                    if goes_on:
                        begin[0] = carry[name]
                    v = np.repeat(begin, size)
                else:
                    if goes_on:
                        v[0] = _OPS[op](v[0], carry[name])
                    total = _OPS[op].accumulate(v)
                    before = np.append(0, total[starts[1:] - 1])
                    v = total - np.repeat(before, size) if op == "add" else total ^ np.repeat(before, size)
                carry[name] = v[-1]
                out.append(pa.array(v))
            last = own[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *[f"run_{n}" for n in values]])

    schema = ", ".join(f"{n} {k}" for n, k in fields) + "".join(f", run_{n} long" for n in values)
    dealt = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(run, schema)
    dealt = written(dealt.withColumn("_row", F.monotonically_increasing_id()), tag)
    part = F.shiftright("_row", 33)
    ends = dealt.groupBy(part.alias("part")).agg(F.min(F.struct("_row", key)).alias("a"), F.max(F.struct("_row", key, *[f"run_{n}" for n in values])).alias("b")).orderBy("part").collect()
    before, last, held = [], None, {}
    for r in ends:
        first, end = r["a"][key], r["b"]
        goes_on = last is not None and first == last
        if goes_on:
            before.append((r["part"], first, *[held[n] for n in values]))
        own = {n: end[f"run_{n}"] for n in values}
        if goes_on and end[key] == first:
            own = {n: held[n] if op == "first" else held[n] + own[n] if op == "add" else held[n] ^ own[n] for n, op in values.items()}
        last, held = end[key], own
    parts = spark.createDataFrame(before, "_part long, _first long" + "".join(f", _{n} long" for n in values))
    joined = dealt.withColumn("_part", part).join(F.broadcast(parts), "_part", "left")
    on = F.col("_first").isNotNull() & (F.col(key) == F.col("_first"))

    def whole(name: str, op: str) -> Column:
        own, more = F.col(f"run_{name}"), F.col(f"_{name}")
        return F.when(on, more if op == "first" else own + more if op == "add" else own.bitwiseXOR(more)).otherwise(own).alias(f"run_{name}")

    return joined.select(*[n for n, _ in fields], *[whole(n, op) for n, op in values.items()])


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``name``: a key of each row that stays the same wherever the row is read.

    That is its place in its Parquet file; rows that come from elsewhere are
    written out once, with a number.
    """
    try:
        place = F.concat(F.hex(F.xxhash64("_metadata.file_path")), F.lit(":"), F.col("_metadata.row_index"))
        return docs.select("*", place.alias(name))
    except AnalysisException:
        return written(docs.withColumn(name, F.monotonically_increasing_id().cast("string")), "keyed")


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``docs`` has such a column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Rows of a two-column side that may be broadcast: some 50 MB.
MOST_BROADCAST = 1_000_000


def sized(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` marked for broadcast if it has ``most`` rows at most; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def cutoff(df: DataFrame, count: str, most: int) -> int:
    """The least count that no more than ``most`` rows reach; rows with equal counts are in or out together.

    Counts are tallied by value, from 65,536 on by powers of two, so the driver
    gets a bounded histogram and no task sorts the rows.
    """
    bucket = F.when(F.col(count) < 65536, F.col(count)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(count))).cast("long"))
    tally = sorted(((r["b"], r["n"]) for r in df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, rows = 1 << 62, 0
    for value, n in tally:
        rows += n
        if rows > most:
            break
        least = value
    return least
