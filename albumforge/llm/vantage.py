"""Largest inner products by vantage-point trees, one per shard.

Vectors get one more coordinate, sqrt(M^2 - |x|^2), with M the largest length
of all; queries get a 0. Then the nearest by distance are those with the
largest inner product, and the triangle inequality holds. A subtree is left out
when the gap between the query and the range of its distances to the vantage
point, times ``factor``, is above the k-th distance found: ``factor`` 1 is
exact, larger ones search less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumforge.llm.common import clashing, written

LEAF = 512


class Tree:
    """Nodes in arrays: vantage row, the two children, and for each child the range of distances to the vantage point."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.points, self.ids = points, ids
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []
        if len(ids):
            self._build(0, len(ids), leaf)

    def _build(self, lo: int, hi: int, leaf: int) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        rows = self.order[lo:hi]
        if hi - lo <= leaf:
            self.nodes[me] = (-1, lo, hi)
            return me
        x = self.points[rows]
        # Far from the middle: the farthest row from the mean spreads distances most.
        at = int(np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
        vantage = rows[at]
        d = np.sqrt(((x - self.points[vantage]) ** 2).sum(axis=1))
        by = np.argsort(d, kind="stable")
        self.order[lo:hi], d = rows[by], d[by]
        # Halves by rank, so a crowd of equal vectors can't make a child without end.
        mid = (hi - lo) // 2
        near = self._build(lo, lo + mid, leaf)
        far = self._build(lo + mid, hi, leaf)
        self.nodes[me] = (vantage, near, far, d[0], d[mid - 1], d[mid], d[-1])
        return me

    def search(self, queries: np.ndarray, skip: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (k columns, -1 and -inf where fewer are found) of a block of queries."""
        n = len(queries)
        self.best, self.found = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        self.q, self.skip, self.k, self.factor = queries, skip, k, factor
        self.length = (queries**2).sum(axis=1)
        self.reach = np.full(n, np.inf)
        if self.nodes:
            # One squared length holds for all stored points: M^2.
            self.square = float((self.points[0] ** 2).sum())
            self._walk(0, np.arange(n))
        return self.found, self.best

    def _walk(self, node: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if self.nodes[node][0] < 0:
            self._leaf(rows, *self.nodes[node][1:3])
            return
        vantage, near, far, a, b, c, e = self.nodes[node]
        d = np.sqrt(((self.q[rows] - self.points[vantage]) ** 2).sum(axis=1))
        first = d <= (b + c) / 2
        for own, one, lo1, hi1, two, lo2, hi2 in ((first, near, a, b, far, c, e), (~first, far, c, e, near, a, b)):
            r, dr = rows[own], d[own]
            for child, lo, hi in ((one, lo1, hi1), (two, lo2, hi2)):
                gap = np.maximum(lo - dr, dr - hi)
                self._walk(child, r[gap * self.factor <= self.reach[r]])

    def _leaf(self, rows: np.ndarray, lo: int, hi: int) -> None:
        own = self.order[lo:hi]
        # A matrix product sums in an order of its own: it picks, and what it picks is summed again in the order of the components.
        rough = self.q[rows] @ self.points[own].T
        slack = 1e-9 * (self.square + self.length[rows])
        picked = (rough >= (self.best[rows, -1] - slack)[:, None]) & (self.ids[own][None, :] != self.skip[rows][:, None])
        i, j = np.nonzero(picked)
        if not len(i):
            return
        q, x, exact = self.q[rows[i]].T, self.points[own[j]].T, np.zeros(len(i))
        for c in range(len(q) - 1):
            exact += q[c] * x[c]
        # What was picked, side by side for each row; after the first leaves that is one or two.
        begin = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        size = np.diff(np.append(begin, len(i)))
        rows, place = rows[i[begin]], np.arange(len(i)) - np.repeat(begin, size)
        line = np.repeat(np.arange(len(rows)), size)
        score, ids = np.full((len(rows), self.k + size.max()), -np.inf), np.full((len(rows), self.k + size.max()), -1, np.int64)
        score[:, :self.k], ids[:, :self.k] = self.best[rows], self.found[rows]
        score[line, self.k + place], ids[line, self.k + place] = exact, self.ids[own][j]
        by = np.lexsort((ids, -score), axis=1)[:, :self.k]
        self.best[rows] = np.take_along_axis(score, by, axis=1)
        self.found[rows] = np.where(np.isinf(self.best[rows]), -1, np.take_along_axis(ids, by, axis=1))
        worst = self.best[rows, -1]
        square = self.length[rows] + self.square - 2 * worst
        # A little slack for rounding, so that ties are never cut off.
        self.reach[rows] = np.where(np.isinf(worst), np.inf, np.sqrt(np.maximum(square, 0)) * (1 + 1e-9) + 1e-6 * np.sqrt(self.square))


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id and vector (doubles) of the rows that take part: not null, not all zero, every component finite, of the common length."""
    x = clashing(vectors, id_column, vector_column).select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("x"))
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & good & F.exists("x", lambda c: c != 0))


def nearest(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", query_every: int = 20, k: int = 20,
            factor: float = 1.0, shard_rows: int = 16384, block_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of each query, nearest first, ties to the smaller id.

    Queries are the rows whose id is divisible by ``query_every``; a query's
    own id is no candidate. Rows with a null id, and null, zero or non-finite
    vectors, take no part; no rows give an empty result. A repeated id counts
    as one candidate per row.
    """
    spark = vectors.sparkSession
    good = written(usable(vectors, id_column, vector_column).withColumn("square", F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)), "near-vectors")
    row = good.agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not row["n"]:
        return spark.createDataFrame([], empty)
    square = row["square"]
    shards = -(-row["n"] // shard_rows)
    blocks = max(1, -(-row["n"] // query_every // block_rows))
    dim = F.size("x")
    pieces = good.withColumn("dim", dim)

    def packed(rows: DataFrame, key: str, count: int, name: str) -> DataFrame:
        """Rows of one key as two arrays; at most about shard_rows or block_rows each, as ids are dealt by hash."""
        dealt = rows.withColumn(key, F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))
        return dealt.groupBy(key, "dim").agg(F.collect_list("vec_id").alias(f"{name}_ids"), F.flatten(F.collect_list("x")).alias(name))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, width, ids, x in zip(*[batch.column(c) for c in ("shard", "dim", "tree_ids", "tree")], strict=True):
                x = x.values.to_numpy(zero_copy_only=False).reshape(-1, width.as_py())
                ids = ids.values.to_numpy(zero_copy_only=False)
                extra = np.sqrt(np.maximum(square - (x**2).sum(axis=1), 0))
                tree = Tree(np.hstack([x, extra[:, None]]), ids)
                rows = tree.order
                inner = [n + (0,) * (7 - len(n)) for n in tree.nodes]
                place = {r: i for i, r in enumerate(rows)}
                nodes = np.array([(place[n[0]] if n[0] >= 0 else -1, *n[1:]) for n in inner], np.float64)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard.as_py()], pa.int32()), "dim": pa.array([width.as_py()], pa.int32()),
                                                  "tree_ids": [ids[rows].tobytes()], "points": [tree.points[rows].tobytes()], "nodes": [nodes.tobytes()]})

    trees = written(packed(pieces, "shard", shards, "tree").mapInArrow(
        build, "shard int, dim int, tree_ids binary, points binary, nodes binary"), "near-trees")
    asked = packed(pieces.filter(F.col("vec_id") % query_every == 0), "block", blocks, "query")
    sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition("shard", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, i=i: batch.column(c)[i]
                width = get("dim").as_py()
                tree = Tree(np.empty((0, width + 1)), np.empty(0, np.int64))
                tree.ids = np.frombuffer(get("tree_ids").as_buffer(), np.int64)
                tree.points = np.frombuffer(get("points").as_buffer(), np.float64).reshape(-1, width + 1)
                tree.order = np.arange(len(tree.ids))
                raw = np.frombuffer(get("nodes").as_buffer(), np.float64).reshape(-1, 7)
                tree.nodes = [(int(r[0]), int(r[1]), int(r[2]), *r[3:]) for r in raw]
                q = get("query").values.to_numpy(zero_copy_only=False).reshape(-1, width)
                ids = get("query_ids").values.to_numpy(zero_copy_only=False)
                found, score = tree.search(np.hstack([q, np.zeros((len(q), 1))]), ids, k, factor)
                keep = found >= 0
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(ids, keep.sum(axis=1)), "vec_id": found[keep], "score": score[keep]})

    pairs = sent.join(trees, ["shard", "dim"]).mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
