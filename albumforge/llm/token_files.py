"""Token-id files: shards of ids under a Re-Pair grammar, with random access.

Documents are dealt by ranges of their id and written in ascending order. A
shard is a row of a Parquet table: the ids of its documents, compressed. In
rounds, the most frequent neighbouring pairs of a shard get nonterminals and
are replaced from left to right, until no pair is frequent; a rule is a pair, and the length of its
expansion is stored with it, so a place in the shard is found by adding up
lengths, without decoding what comes before.

Payload, little-endian: 8 bytes magic, then int64 counts of terminals'
bound, rules, symbols; then int32 left and right of each rule, int64 expansion
length of each rule, and the symbols in 2 or 4 bytes each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from albumforge.llm.common import clashing, written
from albumforge.llm.encode import gather, string_blocks, worker_encoder
from albumforge.llm.workers import lean

MAGIC = b"repair01"
#: Ids after which a shard is closed (a document is never split); rules of a round, least count of a pair.
SHARD_IDS, ROUND_RULES, LEAST = 1 << 20, 2048, 12
CELLS = 1 << 18


def _pairs(symbols: np.ndarray) -> np.ndarray:
    return symbols[:-1].astype(np.int64) << 32 | symbols[1:]


def _cells(code: np.ndarray) -> np.ndarray:
    return (code * np.int64(-7046029254386353131) >> np.int64(64 - 18)) & np.int64(CELLS - 1)


def _frequent(code: np.ndarray, cell: np.ndarray, most: int, least: int) -> tuple[np.ndarray, bool]:
    """The most frequent pair codes, counted exactly, and whether they are all that stand ``least`` times; pairs in cells that are too empty can't be frequent and are not sorted."""
    filled = np.bincount(cell, minlength=CELLS)
    cut = least
    if (filled >= cut).sum() > 4 * most:
        cut = max(cut, int(np.partition(filled, -4 * most)[-4 * most]))
    found, n = np.unique(code[filled[cell] >= cut], return_counts=True)
    keep = n >= least
    if cut > least and not keep.any():
        # Full cells of rare pairs only: emptier cells may still hold a frequent one.
        cut = least
        found, n = np.unique(code[filled[cell] >= cut], return_counts=True)
        keep = n >= least
    found, n = found[keep], n[keep]
    return found[np.lexsort((found, -n))[:most]], cut == least and len(found) <= most


def compress(ids: np.ndarray, rounds: int | None = None, round_rules: int = ROUND_RULES, least: int = LEAST) -> bytes:
    """A shard's payload. Rounds go on until no pair stands ``least`` times, or for ``rounds`` of them."""
    symbols = ids.astype(np.int32)
    bound = int(symbols.max()) + 1 if len(symbols) else 0
    left, right, lengths, look = [], [], np.ones(bound, np.int64), None
    for _ in count() if rounds is None else range(rounds):
        if len(symbols) < 2:
            break
        code = _pairs(symbols) if look is None else symbols[look].astype(np.int64) << 32 | symbols[look + 1]
        cell = _cells(code)
        rules, whole = _frequent(code, cell, round_rules, least)
        if not len(rules):
            break
        by = np.sort(rules)
        marked = np.zeros(CELLS, bool)
        marked[_cells(by)] = True
        hit = np.flatnonzero(marked[cell])
        own = code[hit]
        at = np.minimum(np.searchsorted(by, own), len(by) - 1)
        same = by[at] == own
        hit, at = hit[same] if look is None else look[hit[same]], at[same]
        # Overlapping hits: within a run of hits every second one is taken, from the left.
        begins = np.flatnonzero(np.append(True, hit[1:] != hit[:-1] + 1))
        since = np.arange(len(hit)) - np.repeat(begins, np.diff(np.append(begins, len(hit))))
        taken = since % 2 == 0
        hit, at = hit[taken], at[taken]
        used = np.flatnonzero(np.bincount(at, minlength=len(by)))
        name = np.zeros(len(by), np.int64)
        name[used] = np.arange(len(used))
        a, b = (by[used] >> 32).astype(np.int64), (by[used] & 0xFFFFFFFF).astype(np.int64)
        base = len(lengths)
        lengths = np.concatenate([lengths, lengths[a] + lengths[b]])
        left.append(a)
        right.append(b)
        stay = np.ones(len(symbols), bool)
        stay[hit + 1] = False
        symbols[hit] = base + name[at]
        symbols = symbols[stay]
        look = None
        if whole:
            # Every frequent pair was replaced wherever it stood: only pairs with a new symbol can be frequent next time.
            new = symbols >= base
            look = np.flatnonzero(new[:-1] | new[1:])
    a, b = (np.concatenate(x).astype("<i4") if x else np.empty(0, "<i4") for x in (left, right))
    head = np.array([bound, len(a), len(symbols)], "<i8").tobytes()
    width = "<u2" if len(lengths) <= 1 << 16 else "<u4"
    return b"".join([MAGIC, head, a.tobytes(), b.tobytes(), lengths[bound:].astype("<i8").tobytes(), symbols.astype(width).tobytes()])


class Shard:
    """A payload opened for reading: ``ids(start, stop)`` decodes that stretch only."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.bound, rules, n = (int(x) for x in np.frombuffer(payload, "<i8", 3, 8))
        at = 32
        self.left = np.frombuffer(payload, "<i4", rules, at)
        self.right = np.frombuffer(payload, "<i4", rules, at + 4 * rules)
        self.rule_lengths = np.frombuffer(payload, "<i8", rules, at + 8 * rules)
        width = "<u2" if self.bound + rules <= 1 << 16 else "<u4"
        self.symbols = np.frombuffer(payload, width, n, at + 16 * rules)
        self.lengths = np.concatenate([np.ones(self.bound, np.int64), self.rule_lengths])
        self.ends = np.cumsum(self.lengths[self.symbols])

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        while len(symbols) and (deep := symbols >= self.bound).any():
            out = np.repeat(symbols, 1 + deep)
            first = np.cumsum(1 + deep) - (1 + deep)
            rule = symbols[deep] - self.bound
            out[first[deep]], out[first[deep] + 1] = self.left[rule], self.right[rule]
            symbols = out
        return symbols.astype(np.uint32)

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def all(self) -> np.ndarray:
        """All ids: every rule is expanded once, in the order of its making, then looked up."""
        if not len(self.left):
            return self.symbols.astype(np.uint32)
        used = self._expand(np.arange(self.bound, self.bound + len(self.left)))
        flat = np.concatenate([np.arange(self.bound, dtype=np.uint32), used])
        starts = np.cumsum(self.lengths) - self.lengths
        return gather(flat, starts[self.symbols], self.lengths[self.symbols])

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.empty(0, np.uint32)
        lo, hi = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        before = int(self.ends[lo - 1]) if lo else 0
        return self._expand(self.symbols[lo:hi])[start - before:stop - before]


SHARDS = "part int, shard int, doc_ids array<{kind}>, doc_lengths array<bigint>, n_ids long, payload binary"


def write_token_files(docs: DataFrame, folder: str | None, path: str, end: int = 2, id_column: str = "doc_id", text_column: str = "text",
                      shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every text, end each with ``end``, write shards in ascending order of id, and return the table of them.

    Null texts are empty (the end id alone), null ids come first, equal rows are
    written each. Rows that share an id are dealt by text, so any number of them
    may. A text is never cut: a very long one makes its shard longer. Other
    columns are left out. ``folder`` None: a table of its own in the shared folder.
    """
    named = clashing(docs, id_column, text_column).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    arrow_kind = to_arrow_type(named.schema["doc_id"].dataType)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = worker_encoder(path, end, True), 0
        ids, counts, keys = np.empty(0, np.uint32), np.empty(0, np.int64), []
        part = 0

        def shard(n: int) -> pa.RecordBatch:
            own = ids[:counts[:n].sum()]
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([keys[:n]], pa.list_(arrow_kind)),
                pa.array([counts[:n].tolist()], pa.list_(pa.int64())), pa.array([len(own)], pa.int64()), pa.array([compress(own)], pa.binary())],
                names=["part", "shard", "doc_ids", "doc_lengths", "n_ids", "payload"])

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for lo, texts in string_blocks(batch.column(1)):
                new, new_counts = encoder.encode(texts)
                ids, counts = np.concatenate([ids, new]), np.concatenate([counts, new_counts])
                keys += batch.column(0).slice(lo, len(new_counts)).to_pylist()
                while len(ids) >= shard_ids:
                    n = int(np.searchsorted(np.cumsum(counts), shard_ids)) + 1
                    yield shard(n)
                    ids, counts, keys, number = ids[counts[:n].sum():].copy(), counts[n:], keys[n:], number + 1
        if len(counts):
            yield shard(len(counts))

    ordered = named.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    made = ordered.mapInArrow(lean(shards), SHARDS.format(kind=kind))
    if folder is None:
        return written(made, "token-files")
    made.write.parquet(folder)
    return open_token_files(docs.sparkSession, folder)


def open_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def _starts(files: DataFrame) -> DataFrame:
    """part, shard, shard_start: ids in all shards before. One row per shard; the driver gets one sum per task of the writer."""
    light = files.select("part", "shard", "n_ids")
    sums = sorted((r["part"], r["n"]) for r in light.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    at, base = 0, []
    for part, n in sums:
        base.append((part, at))
        at += n
    bases = F.broadcast(files.sparkSession.createDataFrame(base or [(0, 0)], "part int, base long"))
    own = F.expr("sum(n_ids) OVER (PARTITION BY part ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return light.withColumn("own", F.coalesce(own, F.lit(0))).join(bases, "part").select("part", "shard", (F.col("base") + F.col("own")).alias("shard_start"))


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the decoded files."""
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = Shard(batch.column("payload")[i].as_py()).all().astype("<u4")
                counts = batch.column("doc_lengths")[i].values.to_numpy()
                ends = np.cumsum(counts)
                crc = np.fromiter((zlib.crc32(ids[e - n:e]) for e, n in zip(ends, counts, strict=True)), np.int64, len(ends))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ends), batch.column("part")[i].as_py()), pa.int32()), pa.array(np.full(len(ends), batch.column("shard")[i].as_py()), pa.int32()),
                    batch.column("doc_ids")[i].values, pa.array(ends - counts), pa.array(counts), pa.array(crc)],
                    names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    decoded = files.mapInArrow(lean(decode), f"part int, shard int, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    return decoded.join(_starts(files), ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
