"""Best-fit packing of documents into sequences, by linear grouping.

Pieces are dealt by hash to blocks of bounded size, packed side by side. In a
block, large pieces are sorted by length and cut into groups of equal
cardinality; each length is rounded up to its group's longest, so few sizes
remain. Configurations of these sizes (which ones share a sequence) are chosen
by repeatedly solving a knapsack over the sizes still to be placed and using
the fullest configuration as often as it fits. Then the actual pieces take
their groups' places, the room that rounding wasted is found again, and small
pieces go to the fullest sequence that still takes them.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumforge.llm.common import clashing, written
from albumforge.llm.encode import string_blocks, worker_encoder
from albumforge.llm.workers import lean, lean_group, release, small_batches

CAPACITY = 4096
#: Pieces above this share of the capacity are large; sizes after rounding; tokens, and pieces, that one task packs together.
LARGE, GROUPS, BLOCK_TOKENS, BLOCK_PIECES = 1 / 6, 48, 6_000_000, 200_000
#: Rows that a worker gets and bytes of texts that it encodes at a time, words that it remembers, and bytes after which it gives freed memory back:
#: less than the encoder's own bounds, as packing follows other stages in executors that these have filled.
BATCH_ROWS, BLOCK_BYTES, REMEMBERED, RELEASE_BYTES = 1000, 1 << 19, 200_000, 16 << 20


def pieces(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each text and an end id, cut where longer than ``capacity``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, done = worker_encoder(path, end, False, REMEMBERED), 0
        for batch in batches:
            done += batch.nbytes
            if done > RELEASE_BYTES:
                release()
                done = 0
            for lo, texts in string_blocks(batch.column(1), BLOCK_BYTES):
                ids, counts = encoder.encode(texts)
                ids = ids.astype("<u4")
                n = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(counts[row] - start, capacity)
                at = (np.cumsum(counts) - counts)[row] + start
                crc = np.fromiter((zlib.crc32(ids[a:a + b]) for a, b in zip(at, length, strict=True)), np.int64, len(at))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(counts)).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])

    named = clashing(docs, id_column, text_column).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(lean(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size give the fullest sequence, by a bounded knapsack over reachable sums."""
    # reach[s]: the size last added on the way to sum s, and the sum before.
    reach: dict[int, tuple[int, int]] = {0: (-1, 0)}
    for i, (size, n) in enumerate(zip(sizes, left, strict=True)):
        if not n or size > capacity:
            continue
        used = dict.fromkeys(reach, 0)
        for s in sorted(reach):
            k, t = used.get(s, 0), s + size
            while t <= capacity and k < n and t not in reach:
                reach[t] = (i, t - size)
                k += 1
                used[t] = k
                t += size
    take, s = [0] * len(sizes), max(reach)
    while s:
        i, s = reach[s]
        take[i] += 1
    return take


def pack_block(lengths: np.ndarray, capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number (from 0) and offset of every piece. No sequence holds more than ``capacity``."""
    n = len(lengths)
    sequence, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    by = np.argsort(-lengths, kind="stable")
    full = int((lengths == capacity).sum())
    sequence[by[:full]] = np.arange(full)
    n_large = int((lengths > capacity * large).sum())
    big = by[full:n_large]
    bins = full
    fill: list[int] = []
    if len(big):
        parts = np.array_split(big, min(groups, len(big)))
        sizes = [int(lengths[p[0]]) for p in parts]
        left, taken = [len(p) for p in parts], [0] * len(parts)
        while any(left):
            take = _fullest(sizes, left, capacity)
            times = min(left[i] // k for i, k in enumerate(take) if k)
            for _ in range(times):
                at = 0
                for i, k in enumerate(take):
                    for x in parts[i][taken[i]:taken[i] + k]:
                        sequence[x], offset[x] = bins, at
                        at += int(lengths[x])
                    taken[i] += k
                fill.append(at)
                bins += 1
            left = [m - times * k for m, k in zip(left, take, strict=True)]
    # Best fit, longest first: the sequence with the least room that still takes it. Rooms are kept in order.
    rooms = sorted((capacity - f, full + i) for i, f in enumerate(fill))
    for x in by[n_large:]:
        length = int(lengths[x])
        at = bisect_left(rooms, (length, -1))
        room, b = rooms.pop(at) if at < len(rooms) else (capacity, bins)
        bins += b == bins
        sequence[x], offset[x] = b, capacity - room
        if room > length:
            insort(rooms, (room - length, b))
    return sequence, offset


def _pack(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"]).reset_index(drop=True)
        sequence, offset = pack_block(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"], pdf["offset"] = (pdf["block"].to_numpy(np.int64) << 32) + sequence, offset
        return pdf.drop(columns="block")
    return pack


def best_fit_packing(docs: DataFrame, path: str, end: int = 1, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece, with its sequence and place in it (gapless from 0).

    Null or empty texts are pieces of the end id alone. Null ids and equal rows
    are packed like any other; other columns are left out. No rows: an empty
    result. Sequences are numbered by block, not without gaps.
    """
    kind = docs.schema[id_column].dataType
    with small_batches(docs.sparkSession, BATCH_ROWS):
        cut = written(pieces(docs, path, end, capacity, id_column, text_column), "pack-pieces")
    size = cut.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("pieces")).first()
    blocks = max(1, -(-size["tokens"] // BLOCK_TOKENS), -(-size["pieces"] // BLOCK_PIECES))
    # Equal pieces differ by their file row only: a random deal would not rerun, and one block is bounded either way.
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(blocks)).cast("int")
    dealt = cut.withColumn("row", F.monotonically_increasing_id()).withColumn("block", spread).drop("row").withColumn("doc_id", F.col("doc_id").cast("string"))
    packed = dealt.groupBy("block").applyInPandas(lean_group(_pack(capacity)), "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind))
