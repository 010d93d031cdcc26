"""Exact largest integer inner products by tiled matrix products.

Vectors are turned into whole numbers and packed into shards, queries into
blocks; both are kept in the smallest integer type that holds them. A task
holds one shard at a time and lets the blocks stream by. Of each tile (a block
times some columns of the shard) only scores above the block's worst are picked;
a shard's top lists are then merged with those of other shards in a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumforge.llm.common import clashing, written
from albumforge.llm.workers import lean

#: Vectors of a shard and queries of a block, columns of a tile, lists that one step of the tree merges.
SHARD_ROWS, BLOCK_ROWS, TILE_COLUMNS, FAN = 32768, 1024, 2048, 16
#: Whole numbers up to this are exact in a double, so products of vectors are while their lengths' product stays below it.
EXACT, LONGEST = 2.0**53, (1 << 63) - 1
_TYPES = {"h": np.int16, "i": np.int32, "d": np.float64}
_PACKED = "part int, dim int, large boolean, ids binary, row_keys binary, kind string, data binary, reach double"


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, x (doubles), reach (a bound of the scaled vector's squared length) and large of the rows that take part."""
    x = clashing(vectors, id_column, vector_column).select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("x"))
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    reach = F.aggregate("x", F.lit(0.0), lambda a, c: a + (F.abs(c) * scale + 1) * (F.abs(c) * scale + 1))
    return x.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & good).withColumn("reach", reach).withColumn("large", F.col("reach") >= EXACT)


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as doubles where these are exact, else as Python's integers."""
    with np.errstate(over="ignore"):
        scaled = x * scale
    if np.all(np.abs(scaled) < EXACT):
        return np.floor(scaled)
    return np.array([int(v) * scale if abs(v) >= 2.0**52 else math.floor(v * scale) for v in x.ravel()], object).reshape(x.shape)


def _pack(rows: int, scale: int):
    """Rows (vec_id, row, x, reach, large) as packed arrays of at most ``rows`` vectors of one width; large vectors stay doubles."""
    def emit(part: int, key: tuple[int, bool], held: list[tuple]) -> pa.RecordBatch:
        dim, large = key
        ids, own, x = (np.concatenate([h[i] for h in held]) for i in range(3))
        by = np.lexsort((own, ids))
        ids, own, x = ids[by], own[by], x.reshape(len(ids), dim)[by]
        kind = "d"
        if not large:
            x = np.floor(x * scale)
            most = max(x.max(initial=0), -x.min(initial=0))
            kind = "h" if most < 2**15 else "i" if most < 2**31 else "d"
        reach = max(h[3] for h in held)
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "dim": pa.array([dim], pa.int32()), "large": [large], "ids": [ids.tobytes()], "row_keys": [own.tobytes()],
                                           "kind": [kind], "data": [x.astype(_TYPES[kind]).tobytes()], "reach": [float(reach)]})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_ = TaskContext.get().partitionId(), {}
        for batch in batches:
            vec, own, lists, reach, large = (batch.column(i) for i in range(5))
            ends = lists.offsets.to_numpy()
            width, flat = np.diff(ends), lists.values.to_numpy(zero_copy_only=False)
            vec, own, reach, large = vec.to_numpy(), own.to_numpy(), reach.to_numpy(), large.to_numpy(zero_copy_only=False)
            for dim in np.unique(width):
                for big in (False, True):
                    mine = np.flatnonzero((width == dim) & (large == big))
                    key = (int(dim), big)
                    while len(mine):
                        held = open_.setdefault(key, [])
                        take, mine = np.split(mine, [rows - sum(len(h[0]) for h in held)])
                        held.append((vec[take], own[take], flat[(ends[take][:, None] + np.arange(dim)[None, :]).ravel()], reach[take].max()))
                        if sum(len(h[0]) for h in held) == rows:
                            yield emit(part, key, open_.pop(key))
        for key, held in open_.items():
            yield emit(part, key, held)

    return pack


class Packed:
    """One packed array, read again."""

    def __init__(self, row: dict, scale: int):
        self.ids, self.rows = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["row_keys"], np.int64)
        x = np.frombuffer(row["data"], _TYPES[row["kind"]]).reshape(len(self.ids), row["dim"])
        self.key, self.reach = (row["dim"], row["large"]), row["reach"]
        self.x = _whole(x, scale) if row["large"] else x


def products(q: np.ndarray, x: np.ndarray, reach: float) -> np.ndarray:
    """All inner products, exact: in floats where ``reach`` (a bound of them) lets these hold whole numbers, else in Python's integers cut to 64 bits."""
    if reach < EXACT:
        kind = np.float32 if reach < 2.0**24 else np.float64
        return q.astype(kind) @ x.astype(kind).T
    full = np.array([[int(v) for v in r] for r in q], object).reshape(q.shape) @ np.array([[int(v) for v in r] for r in x], object).reshape(x.shape).T
    return np.array([max(-LONGEST, min(LONGEST, v)) for v in full.ravel()], np.int64).reshape(full.shape)


class TopLists:
    """The best ``k`` of each query so far: scores, ids and how many there are; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.ids, self.some = k, np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros(n, np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``rows`` (ascending) get these candidates."""
        if not len(rows):
            return
        begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        size = np.diff(np.append(begin, len(rows)))
        own = rows[begin]
        wide = (len(own), self.k + int(size.max()))
        score, who, empty = np.zeros(wide, np.int64), np.zeros(wide, np.int64), np.ones(wide, bool)
        score[:, :self.k], who[:, :self.k], empty[:, :self.k] = self.score[own], self.ids[own], np.arange(self.k)[None, :] >= self.some[own][:, None]
        line, place = np.repeat(np.arange(len(own)), size), self.k + np.arange(len(rows)) - np.repeat(begin, size)
        score[line, place], who[line, place], empty[line, place] = scores, ids, False
        by = np.lexsort((who, -score, empty), axis=1)[:, :self.k]
        self.score[own], self.ids[own] = np.take_along_axis(score, by, axis=1), np.take_along_axis(who, by, axis=1)
        self.some[own] = np.minimum(self.k, (~empty).sum(axis=1))


def select(block: Packed, shard: Packed, k: int, columns: int = TILE_COLUMNS) -> TopLists:
    """The best ``k`` rows of the shard for each query but its own row, tile by tile."""
    top = TopLists(len(block.ids), k)
    reach = math.sqrt(block.reach) * math.sqrt(shard.reach) * (1 + 1e-9)
    by_row = np.argsort(shard.rows)
    at = np.minimum(np.searchsorted(shard.rows, block.rows, sorter=by_row), len(by_row) - 1)
    own = np.where(shard.rows[by_row[at]] == block.rows, by_row[at], -1)
    lo = 0
    while lo < len(shard.ids):
        # A narrow first tile sets the mark that the others have to pass.
        hi = min(len(shard.ids), lo + (columns if lo else max(64, 8 * k)))
        scores = products(block.x, shard.x[lo:hi], reach)
        open_ = np.ones(scores.shape, bool)
        mine = np.flatnonzero((own >= lo) & (own < hi))
        open_[mine, own[mine] - lo] = False
        full = top.some == k
        # Columns ascend by id, so a later one that ties with the worst can't come in.
        i, j = np.nonzero(open_ & ((scores > top.score[:, -1:]) | ~full[:, None]))
        top.add(i, scores[i, j].astype(np.int64), shard.ids[lo + j])
        lo = hi
    return top


def _lists(part: int, block: int, ids: bytes, top: TopLists) -> dict:
    return {"node": part, "block": block, "query_ids": ids, "score": top.score.tobytes(), "vec": top.ids.tobytes(), "some": top.some.tobytes()}


_LISTS = "node int, block long, query_ids binary, score binary, vec binary, some binary"


def _merger(k: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["query_ids"].iloc[0]
        top = TopLists(len(ids) // 8, k)
        for score, vec, some in zip(pdf["score"], pdf["vec"], pdf["some"], strict=True):
            some = np.frombuffer(some, np.int64)
            there = np.arange(k)[None, :] < some[:, None]
            i, _ = np.nonzero(there)
            top.add(i, np.frombuffer(score, np.int64).reshape(-1, k)[there], np.frombuffer(vec, np.int64).reshape(-1, k)[there])
        return pd.DataFrame([_lists(int(pdf["next"].iloc[0]), int(pdf["block"].iloc[0]), ids, top)])

    return merge


def exact_top_k(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", query_every: int = 50, k: int = 5, scale: int = 256,
                shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of the largest inner product of floor(``scale`` * x), ties to the smaller id.

    Queries are the rows whose id is divisible by ``query_every``; every row but
    the query's own is a candidate, so a row that repeats an id is one, and each
    row of a repeated query id has a list of its own. Rows with a null id, and
    vectors that are null or hold null or non-finite components, take no part;
    zero vectors do. Vectors meet those of their own width only; empty ones score
    0. Scores past 64 bits count as the nearest long. Long vectors make larger
    shards; other columns are left out. No rows: an empty result.
    """
    spark = vectors.sparkSession
    good = written(usable(vectors, id_column, vector_column, scale).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    asked = good.filter(F.col("vec_id") % query_every == 0)
    n, queries = good.count(), asked.count()
    if not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Small inputs still use every core.
    shards = max(-(-n // shard_rows), min(spark.sparkContext.defaultParallelism, -(-n // 1024)))
    columns = ["vec_id", "row", "x", "reach", "large"]
    tiles = good.select(columns).repartition(shards).mapInArrow(lean(_pack(shard_rows, scale)), _PACKED)
    blocks = asked.select(columns).repartition(-(-queries // block_rows)).mapInArrow(lean(_pack(block_rows, scale)), _PACKED)
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "topk-blocks")
    # A shard comes first in its partition, then the blocks that it has to meet, one by one.
    both = tiles.withColumn("block", F.lit(-1).cast("long")).unionByName(blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    met = both.repartition(shards, "part").sortWithinPartitions("part", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if row["part"] != part:
                    part, held = row["part"], []
                if row["block"] < 0:
                    held.append(Packed(row, scale))
                    continue
                asked = Packed(row, scale)
                for shard in held:
                    if shard.key[0] == asked.key[0]:
                        yield pa.RecordBatch.from_pylist([_lists(part, row["block"], row["ids"], select(asked, shard, k))], schema=_LISTS_ARROW)

    lists, nodes = met.mapInArrow(lean(search), _LISTS), shards
    while True:
        nodes = -(-nodes // fan)
        lists = lists.withColumn("next", F.floor(F.col("node") / fan).cast("int")).groupBy("block", "next").applyInPandas(_merger(k), _LISTS)
        if nodes == 1:
            break

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, i=i: np.frombuffer(batch.column(c)[i].as_buffer(), np.int64)
                ids, some = get("query_ids"), get("some")
                there = np.arange(k)[None, :] < some[:, None]
                line, place = np.nonzero(there)
                yield pa.RecordBatch.from_arrays([pa.array(ids[line]), pa.array((place + 1).astype(np.int32)), pa.array(get("vec").reshape(-1, k)[there]), pa.array(get("score").reshape(-1, k)[there])],
                                                 names=["query_id", "rank", "vec_id", "score"])

    return lists.mapInArrow(unpacked, "query_id long, rank int, vec_id long, score long")


_LISTS_ARROW = pa.schema([("node", pa.int32()), ("block", pa.int64()), ("query_ids", pa.binary()), ("score", pa.binary()), ("vec", pa.binary()), ("some", pa.binary())])
