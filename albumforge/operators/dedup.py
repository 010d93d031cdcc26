"""Exact and near duplicates.

Exact copies are found by fingerprint with one mergeable aggregate; the file
content itself never crosses a shuffle.

Near duplicates follow a greedy rule that depends on what was kept before, so a
library is walked in name order with the last few kept fingerprints as state. A
library of any size is walked in pieces, in parallel: see ``near_duplicates``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from albumforge.functions.text import natural_key
from albumforge.operators.ordering import spread_sorted, with_positions
from albumforge.session import cut_lineage

# The near-duplicate rule.
HAMMING_THRESHOLD = 10
WINDOW = 5
MASK = 0xFFFFFFFFFFFFFFFF


def fingerprint(content: Column) -> Column:
    """Digest of the whole content: equal for byte-equal files only."""
    return F.sha2(content, 256)


def exact_duplicates(files: DataFrame, keys: Sequence[str] = ("library_id",), fp: str = "fingerprint",
                     order: str = "ordinal") -> DataFrame:
    """Add ``status`` ('kept' or 'exact') and ``first_ordinal``; the first file in input order is kept.

    The aggregate combines before its shuffle and only fingerprints seen more
    than once are joined back; a fingerprint with very many copies is split by
    the adaptive skew join.
    """
    group = [*keys, fp]
    firsts = (
        files.groupBy(*group).agg(F.min(order).alias("_first"), F.count("*").alias("_copies"))
        .where("_copies > 1").drop("_copies")
    )
    later = F.coalesce(F.col("_first") != F.col(order), F.lit(False))
    return (
        files.join(firsts, group, "left")
        .withColumn("status", F.when(later, F.lit("exact")).otherwise(F.lit("kept")))
        .withColumn("first_ordinal", F.when(later, F.col("_first")))
        .drop("_first")
    )


class RecentKept:
    """The last kept fingerprints of one library, newest last. A missing one takes a place too."""

    def __init__(self, entries: Sequence[tuple[int | None, str]] = (), threshold: int = HAMMING_THRESHOLD,
                 window: int = WINDOW):
        self.entries: deque = deque(entries, maxlen=window)
        self.threshold = threshold

    def visit(self, photo_id: str, value: int | None) -> tuple[str, str | None, int | None, int | None]:
        """(status, representative, distance to it, nearest miss of a kept photo)."""
        best, rep = None, None
        if value is not None:
            for kept, kept_id in reversed(self.entries):
                if kept is None:
                    continue
                distance = ((kept ^ value) & MASK).bit_count()
                if best is None or distance < best:
                    best, rep = distance, kept_id
            if best is not None and best <= self.threshold:
                return "burst", rep, best, None
        self.entries.append((value, photo_id))
        return "kept", None, None, best


@dataclass(frozen=True)
class Slot:
    """A kept photo of an earlier piece, known by its place in what was handed on."""

    number: int


def _walked(batch: pa.RecordBatch, library_id: str) -> Iterator[tuple]:
    """(library, photo, hash or None, part) per row; Arrow keeps 64-bit values exact beside nulls."""
    return zip(*(batch.column(c).to_pylist() for c in (library_id, "photo_id", "hash", "_part")))


def near_duplicates(photos: DataFrame, threshold: int = HAMMING_THRESHOLD, window: int = WINDOW,
                    library_id: str = "library_id", partitions: int | None = None) -> DataFrame:
    """Add ``status`` (kept/burst), ``rep_id``, ``distance``, ``nearest_distance`` and ``visit``.

    ``photos`` has ``photo_id``, ``name``, ``ordinal`` and ``hash`` (BIGINT or null).

    The photos are range-partitioned by (library, natural name), so a big
    library runs through many tasks. A task's result depends on the tasks before
    it only through the few photos last kept there. First every task walks its
    piece as if nothing came before and reports what it ends with. Then the ends
    are handed on, and only pieces that start from other hashes than assumed and
    lie wholly inside one library are walked again, until no end changes. A
    piece that passes on what it was handed says so by place, so which photo it
    is gets filled in at the end: a library of equal pictures takes two rounds,
    however many pieces it has. The driver sees one row per task.
    """
    lib_type = photos.schema[library_id].dataType
    laid = spread_sorted(
        photos.select(library_id, "photo_id", "hash",
                      F.col("ordinal").cast("bigint").alias("ordinal"), natural_key(F.col("name")).alias("_name")),
        [library_id], [F.col("_name").asc_nulls_first(), F.col("ordinal").asc()], partitions, drop=["_name"])

    end_schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("first", lib_type), T.StructField("last", lib_type),
        T.StructField("hashes", T.ArrayType(T.LongType())),
        T.StructField("ids", T.ArrayType(photos.schema["photo_id"].dataType)),
        T.StructField("slots", T.ArrayType(T.IntegerType()))])
    out_schema = T.StructType([
        T.StructField(library_id, lib_type), photos.schema["photo_id"],
        T.StructField("ordinal", T.LongType()), T.StructField("visit", T.LongType()),
        T.StructField("status", T.StringType()), T.StructField("rep_id", photos.schema["photo_id"].dataType),
        T.StructField("distance", T.IntegerType()), T.StructField("nearest_distance", T.IntegerType())])
    end_arrow, out_arrow = to_arrow_schema(end_schema), to_arrow_schema(out_schema)

    def starting(entries: dict, part: int) -> RecentKept:
        return RecentKept(entries.get(part, ()), threshold, window)

    def ends_of(assumed: dict):
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent, first, last, part = None, None, None, None
            for batch in batches:
                for lib, pid, value, p in _walked(batch, library_id):
                    if recent is None:
                        # What is handed on is known by its place only.
                        handed = [(h, Slot(k)) for k, h in enumerate(assumed.get(p, ()))]
                        recent, first, part = RecentKept(handed, threshold, window), lib, p
                    elif lib != last:
                        recent = RecentKept((), threshold, window)
                    last = lib
                    recent.visit(pid, value)
            if recent is not None:
                yield pa.RecordBatch.from_pydict({
                    "part": [part], "first": [first], "last": [last],
                    "hashes": [[h for h, _ in recent.entries]],
                    "ids": [[None if isinstance(i, Slot) else i for _, i in recent.entries]],
                    "slots": [[i.number if isinstance(i, Slot) else None for _, i in recent.entries]],
                }, schema=end_arrow)

        return walk

    def statuses(entries: dict):
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent, last = None, None
            for batch in batches:
                found = []
                for lib, pid, value, p in _walked(batch, library_id):
                    if recent is None:
                        recent = starting(entries, p)
                    elif lib != last:
                        recent = RecentKept((), threshold, window)
                    last = lib
                    found.append(recent.visit(pid, value))
                columns = [batch.column(c) for c in (library_id, "photo_id", "ordinal", "_row")]
                columns += [pa.array(c, type=f.type) for c, f in zip(zip(*found), list(out_arrow)[4:])]
                yield pa.RecordBatch.from_arrays(columns, schema=out_arrow)

        return walk

    ends: dict[int, dict] = {}
    assumed: dict[int, tuple] = {}
    pending: list[int] | None = None
    while pending is None or pending:
        todo = laid if pending is None else laid.where(F.col("_part").isin(pending))
        # One row per task, each with at most ``window`` fingerprints.
        for row in todo.mapInArrow(ends_of(assumed), end_schema).collect():
            ends[row["part"]] = row
        order = sorted(ends)
        handed = {after: tuple(ends[before]["hashes"]) for before, after in zip(order, order[1:])
                  if ends[before]["last"] == ends[after]["first"]}
        pending = [p for p in handed
                   if handed[p] != assumed.get(p, ()) and ends[p]["first"] == ends[p]["last"]]
        assumed = handed

    entries: dict[int, tuple] = {}
    for before, after in zip(order, order[1:]):
        if after in assumed:
            start, end = entries.get(before, ()), ends[before]
            entries[after] = tuple((h, i if k is None else start[k][1]) for h, i, k in zip(end["hashes"], end["ids"], end["slots"]))

    return laid.mapInArrow(statuses(entries), out_schema)


def burst_members(marked: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Burst photos with their number inside the group, in visit order, and the group size.

    One row per candidate instead of an array: one photo may have any number of near copies.
    """
    # Written once: the walk behind ``marked`` runs in Python workers.
    bursts = cut_lineage(
        marked.where(F.col("status") == "burst").select(library_id, "rep_id", "photo_id", "visit", "distance"))
    return with_positions(bursts, [library_id, "rep_id"], [F.col("visit").asc()], out="candidate_no", size="candidates")


def burst_ids(marked: DataFrame, library_id: str = "library_id") -> DataFrame:
    """``burst`` = 'b<n>' for representatives and candidates; groups count from 0 in order of discovery."""
    bursts = cut_lineage(marked.where(F.col("status") == "burst").select(library_id, "rep_id", "photo_id", "visit"))
    groups = bursts.groupBy(library_id, "rep_id").agg(F.min("visit").alias("_found"))
    numbered = with_positions(groups, [library_id], [F.col("_found").asc()], out="_no").select(
        library_id, "rep_id", F.concat(F.lit("b"), F.col("_no").cast("string")).alias("burst"))
    members = bursts.select(library_id, "rep_id", "photo_id").join(numbered, [library_id, "rep_id"])
    return members.select(library_id, "photo_id", "burst").unionByName(
        numbered.select(library_id, F.col("rep_id").alias("photo_id"), "burst"))


def dedup(files: DataFrame, threshold: int = HAMMING_THRESHOLD, library_id: str = "library_id") -> DataFrame:
    """Both passes: every photo with ``status`` kept, burst or exact.

    ``files`` has ``fingerprint`` and ``hash``. Exact copies take no part in the second pass.
    """
    first = exact_duplicates(files, [library_id])
    unique = first.where(F.col("status") == "kept")
    near = near_duplicates(unique, threshold, library_id=library_id).select(
        library_id, "photo_id", "status", "rep_id", "distance", "nearest_distance", "visit")
    kept = unique.drop("status", "first_ordinal").join(near, [library_id, "photo_id"])
    copies = first.where(F.col("status") == "exact").drop("first_ordinal")
    return kept.unionByName(copies, allowMissingColumns=True)
