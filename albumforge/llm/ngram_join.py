"""N-gram Jaccard join by filtering under several global orders.

Two sets that reach the threshold share some of their first shingles under any
global order, so they must do so under every one. The first order puts
shingles that are frequent in the corpus last (counted for all documents in a
sketch of fixed size: a shared cell only makes the order less apt, never wrong)
and shuffles the rest by a hash. It gives each set its prefix, and with it the
exact number of sets that share each shingle of a prefix. That number is the
second order, over the prefixes: a pair that needs l common shingles in its
prefixes must have the first of them before the last l - 1 places. Further
orders, by other hashes, sift the candidates that are left, before whole sets
are compared.

Nodes are distinct shingle sets: exact copies meet once. In a group of sets
that share a shingle, each is held against the one with the fewest shingles of
its own, which for copies with edits is their origin; sets still apart after that are compared across components only, so a group of alike sets never
gives all its pairs, and no link between components is missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumforge.llm.common import clashing, written
from albumforge.llm.encode import string_blocks
from albumforge.llm.graph import components
from albumforge.llm.shingles import digests, mixed, shingle_sets
from albumforge.llm.workers import lean

#: Sketch cells as a power of two; sets whose digests a task remembers, to pass over copies; count class from which a shingle's postings are salted.
CELL_BITS, SEEN, HOT_CLASS, SALTS = 21, 1_000_000, 15, 32
MARK_BITS = 25
BLOCK = 1 << 19


def _cells(shingles: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if counts.max(initial=0) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), f"<u{blob[0]}").astype(np.int64)


def _merged(blobs: DataFrame, fan_in: int = 16) -> np.ndarray | None:
    """Sum of fixed-size sketches (column ``sketch``) through a tree; the driver gets ``fan_in`` of them at most."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for blob in pdf["sketch"]:
            total = total + _unpacked(blob)
        return pd.DataFrame({"sketch": [_packed(total)]})

    while (n := blobs.count()) > fan_in:
        groups = -(-n // fan_in)
        # Short rows in any order: a sum does not depend on it.
        blobs = written(blobs.withColumn("g", F.pmod(F.xxhash64("sketch"), F.lit(groups))).groupBy("g").applyInPandas(add, "sketch binary"), "sketch")
    rows = [r["sketch"] for r in blobs.collect()]
    return sum(_unpacked(x) for x in rows) if rows else None


def _ordered(shingles: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """The set sorted under global order number ``order``: rare classes first, then by that order's hash."""
    key = classes[_cells(shingles)].astype(np.uint64) << np.uint64(58) | mixed(shingles, order) >> np.uint64(6)
    return shingles[np.argsort(key)]


def _prefix(n: np.ndarray | int, num: int, den: int):
    """Shingles that must hold a common one: a similar set shares at least num/den of this one's."""
    return n - -(-num * n // den) + 1


class _Sets:
    """Walks batches of (id, text): for each block ids' slice, all shingles, counts and digests, and which sets are new to this task."""

    def __init__(self, words: int):
        self.words, self.seen = words, set()

    def blocks(self, batch: pa.RecordBatch):
        for lo, texts in string_blocks(batch.column(1), BLOCK):
            shingles, counts = shingle_sets(texts, self.words)
            marks = digests(shingles, counts)
            new = np.zeros(len(counts), bool)
            if len(self.seen) > SEEN:
                self.seen.clear()
            for i, m in enumerate(marks.tolist()):
                if counts[i] and m not in self.seen:
                    self.seen.add(m)
                    new[i] = True
            yield lo, shingles, counts, marks, new


def ngram_jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, num: int = 75, den: int = 100,
                       orders: int = 3, hot_class: int = HOT_CLASS) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable over links, its own included).

    Two documents link when den * |intersection| >= num * |union|. Null texts
    and texts without words have no shingles and no links. Null ids: such a row
    gets the smallest id of its component, null when alone. Equal rows are each
    returned. No rows: an empty result. Ids are compared in their own type.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    text = clashing(docs, id_column, text_column).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = text.schema["doc_id"].dataType.simpleString()

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, sketch, none = _Sets(words), np.zeros(1 << CELL_BITS, np.int64), None
        for batch in batches:
            for lo, shingles, counts, marks, new in sets.blocks(batch):
                np.add.at(sketch, _cells(shingles[np.repeat(new, counts)]), 1)
                ids = none = batch.column(0).slice(lo, len(counts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(marks), pa.nulls(len(counts), pa.binary())], names=["doc_id", "n", "digest", "sketch"])
        if none is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, none.type), pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([_packed(sketch)], pa.binary())],
                                             names=["doc_id", "n", "digest", "sketch"])

    surveyed = written(text.mapInArrow(lean(survey), f"doc_id {kind}, n long, digest long, sketch binary"), "ngram-survey")
    nodes = surveyed.filter("n >= 0").drop("sketch")
    counts = _merged(surveyed.filter("n < 0").select("sketch"))
    if counts is None:
        return nodes.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    # 2 MB whatever the input: the number of bits of each cell's count.
    classes = sc.broadcast(np.ceil(np.log2(counts + 1)).astype(np.uint8))

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(words)
        for batch in batches:
            for _, shingles, n, marks, new in sets.blocks(batch):
                ends = np.cumsum(n)
                first = [_ordered(shingles[e - m:e], classes.value, 1)[:_prefix(m, num, den)] for e, m in zip(ends[new], n[new], strict=True)]
                if not first:
                    continue
                lengths, tokens = np.array([len(x) for x in first]), np.concatenate(first)
                marks_of = np.repeat(marks[new], lengths)
                hot = classes.value[_cells(tokens)] >= hot_class
                salt = np.where(hot, 1 + (mixed(marks_of.view(np.uint64), 3) % np.uint64(SALTS)).astype(np.int64), 0)
                yield pa.RecordBatch.from_pydict({"token": tokens.view(np.int64), "salt": salt.astype(np.int32), "digest": marks_of,
                                                  "n": np.repeat(n[new], lengths).astype(np.int32)})

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings of shingles that more than one set's prefix holds, with the number of these sets."""
        for token, salt, mark, n in _whole_groups(batches, ["token", "salt", "digest", "n"], 2):
            again = np.zeros(len(token), bool)
            again[1:] = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1]) & (mark[1:] == mark[:-1])
            token, salt, mark, n = (x[~again] for x in (token, salt, mark, n))
            begin = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])))
            size = np.diff(np.append(begin, len(token)))
            shared = np.where(salt > 0, 1 << 30, np.repeat(size, size))
            keep = shared > 1
            yield pa.RecordBatch.from_pydict({"token": token[keep], "hot": salt[keep] > 0, "digest": mark[keep], "n": n[keep], "shared": shared[keep]})

    dealt = text.mapInArrow(lean(posted), "token long, salt int, digest long, n int").repartition("token", "salt").sortWithinPartitions("token", "salt", "digest")
    shared = dealt.mapInArrow(lean(grouped), "token long, hot boolean, digest long, n int, shared long")
    # Within one set: shingles that no other prefix holds come first, then those that few hold.
    own = Window.partitionBy("digest")
    length = F.expr(f"n - (({num} * n + {den - 1}) div {den}) + 1").cast("int")
    alone = length - F.count(F.lit(1)).over(own).cast("int")
    place = alone + F.row_number().over(own.orderBy("shared", "token")) - 1
    members = written(shared.select("token", "hot", "digest", "n", length.alias("length"), alone.alias("alone"), place.alias("place")), "ngram-members")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of digests that link: the other orders' prefixes first, then whole sets."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << MARK_BITS - 3, np.uint8)
            for batch in batches:
                cells = _cells(batch.column(0).to_numpy().view(np.uint64), MARK_BITS)
                np.bitwise_or.at(bits, cells >> 3, (1 << (cells & 7)).astype(np.uint8))
            if bits.any():
                yield pa.RecordBatch.from_pydict({"sketch": pa.array([_packed(bits)], pa.binary())})

        # At most 4 MB: which digests are wanted. A bit set by another digest only lets a set through that no pair asks for.
        bits = _merged_bits(written(wanted.mapInArrow(lean(mark), "sketch binary"), "ngram-marks"))
        if bits is None:
            return spark.createDataFrame([], "a long, b long")
        sent = sc.broadcast(bits)

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets, asked = _Sets(words), sent.value
            for batch in batches:
                for _, shingles, n, marks, new in sets.blocks(batch):
                    cells = _cells(marks.view(np.uint64), MARK_BITS)
                    new &= (asked[cells >> 3] >> (cells & 7) & 1).astype(bool)
                    ends = np.cumsum(n)
                    own = [shingles[e - m:e] for e, m in zip(ends[new], n[new], strict=True)]
                    firsts = [[_ordered(x, classes.value, k)[:_prefix(len(x), num, den)].view(np.int64) for k in range(2, orders + 1)] for x in own]
                    if own:
                        yield pa.RecordBatch.from_arrays([pa.array(marks[new]), pa.array(firsts, pa.list_(pa.list_(pa.int64()))),
                                                          pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["digest", "firsts", "shingles"])

        sets = written(text.mapInArrow(lean(drawn), "digest long, firsts array<array<long>>, shingles array<long>").dropDuplicates(["digest"]), "ngram-sets")
        firsts, whole = sets.select("digest", "firsts"), sets.select("digest", "shingles")
        sifted = (pairs.join(firsts.toDF("a", "first_a"), "a").join(firsts.toDF("b", "first_b"), "b")
                  .filter(F.forall(F.arrays_zip("first_a", "first_b"), lambda f: F.arrays_overlap(f["first_a"], f["first_b"]))).select("a", "b"))
        common = F.size(F.array_intersect("set_a", "set_b"))
        joined = sifted.join(whole.toDF("a", "set_a"), "a").join(whole.toDF("b", "set_b"), "b")
        return joined.filter((num + den) * common >= num * (F.size("set_a") + F.size("set_b"))).select("a", "b")

    stars = written(_stars(members, num, den).distinct(), "ngram-stars")
    links = written(verified(stars), "ngram-links")
    known = components(links)
    held = members.join(known.toDF("digest", "component"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    across = written(_across(held, num, den).join(stars, ["a", "b"], "left_anti").distinct(), "ngram-across")
    every = components(links.unionByName(verified(across)))
    smallest = nodes.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least_id")).join(every.toDF("digest", "component"), "digest", "left")
    named = smallest.groupBy(F.coalesce("component", "digest").alias("component")).agg(F.min("least_id").alias("component_id"))
    labels = smallest.select("digest", F.coalesce("component", "digest").alias("component")).join(named, "component").select("digest", "component_id")
    out = nodes.withColumn("key", F.when(F.col("n") > 0, F.col("digest"))).join(labels.withColumnRenamed("digest", "key"), "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _merged_bits(blobs: DataFrame, fan_in: int = 16) -> np.ndarray | None:
    def both(pdf: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for blob in pdf["sketch"]:
            total = total | _unpacked(blob)
        return pd.DataFrame({"sketch": [_packed(total)]})

    while (n := blobs.count()) > fan_in:
        groups = -(-n // fan_in)
        blobs = written(blobs.withColumn("g", F.pmod(F.xxhash64("sketch"), F.lit(groups))).groupBy("g").applyInPandas(both, "sketch binary"), "marks")
    total = None
    for r in blobs.collect():
        own = _unpacked(r["sketch"]).astype(np.uint8)
        total = own if total is None else total | own
    return total


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], keys: int) -> Iterator[list[np.ndarray]]:
    """Column arrays that never cut a group of equal keys (the first ``keys`` names) in two; rows come sorted by them."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        changes = np.zeros(batch.num_rows, bool)
        for c in new[:keys]:
            changes[1:] |= c[1:] != c[:-1]
        changes[0] = bool(held) and any(held[-1][k][-1] != new[k][0] for k in range(keys))
        at = np.flatnonzero(changes)
        if not len(at):
            held.append(new)
            continue
        cut = at[-1]
        done = [*held, [c[:cut] for c in new]]
        yield [np.concatenate([d[k] for d in done]) for k in range(len(names))]
        held = [[c[cut:] for c in new]]
    if held:
        yield [np.concatenate([d[k] for d in held]) for k in range(len(names))]


def _close(n1, length1, place1, n2, length2, place2, num: int, den: int):
    """Length filter, and the place filter of the second order: a pair that needs ``l`` common shingles in its prefixes has its first one before the last l - 1."""
    need = -(-num * (n1.astype(np.int64) + n2) // (num + den))
    least = np.minimum(length1 - (n1 - need), length2 - (n2 - need))
    return (den * np.minimum(n1, n2) >= num * np.maximum(n1, n2)) & (np.minimum(length1 - place1, length2 - place2) >= least)


def _close_columns(num: int, den: int) -> str:
    """The same over the columns n, length and place of sides 1 and 2."""
    need = f"(({num} * (n_1 + n_2) + {num + den - 1}) div {num + den})"
    return (f"{den} * least(n_1, n_2) >= {num} * greatest(n_1, n_2) AND "
            f"least(length_1 - place_1, length_2 - place_2) >= least(length_1 - (n_1 - {need}), length_2 - (n_2 - {need}))")


_SIDE = ("digest", "n", "length", "place")


def _side(members: DataFrame, k: int, *more: str) -> DataFrame:
    return members.select("token", *[F.col(c).alias(f"{c}_{k}") for c in (*_SIDE, *more)])


def _by_token(members: DataFrame) -> DataFrame:
    # A shingle below the hot class is in fewer than 2^14 distinct sets, so its group is bounded.
    return members.filter("NOT hot").drop("hot").repartition("token").sortWithinPartitions("token", "alone", "digest")


def _stars(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a < b) of each shingle's leading set, which has the fewest shingles of its own, with its others, where they pass the filters."""
    def starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, mark, n, length, place in _whole_groups(batches, ["token", *_SIDE], 1):
            begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            lead = np.repeat(begin, np.diff(np.append(begin, len(token))))
            good = _close(n[lead], length[lead], place[lead], n, length, place, num, den) & (lead != np.arange(len(lead)))
            if good.any():
                a, b = mark[lead][good], mark[good]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    hot = members.filter("hot")
    first = hot.groupBy("token").agg(F.min(F.struct("alone", *_SIDE)).alias("f")).select("token", *[F.col(f"f.{c}").alias(f"{c}_1") for c in _SIDE])
    far = _side(hot, 2).join(first, "token").filter(f"digest_1 <> digest_2 AND {_close_columns(num, den)}")
    return _by_token(members).mapInArrow(lean(starred), "a long, b long").unionByName(
        far.select(F.least("digest_1", "digest_2").alias("a"), F.greatest("digest_1", "digest_2").alias("b")))


def _across(held: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a < b) of one shingle's sets that lie in different components and pass the filters."""
    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, mark, n, length, place, group in _whole_groups(batches, ["token", *_SIDE, "component"], 1):
            begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            several = np.maximum.reduceat(group, begin) != np.minimum.reduceat(group, begin)
            for lo, hi in zip(begin[several], np.append(begin[1:], len(token))[several], strict=True):
                m, s, z, p, g = (x[lo:hi] for x in (mark, n, length, place, group))
                for at in range(0, hi - lo, 512):
                    cut = slice(at, at + 512)
                    good = ((g[cut, None] != g[None, :]) & (m[cut, None] < m[None, :])
                            & _close(s[cut, None], z[cut, None], p[cut, None], s[None, :], z[None, :], p[None, :], num, den))
                    i, j = np.nonzero(good)
                    if len(i):
                        yield pa.RecordBatch.from_pydict({"a": m[cut][i], "b": m[j]})

    hot = held.filter("hot")
    open_ = hot.groupBy("token").agg((F.min("component") != F.max("component")).alias("open")).filter("open").select("token")
    pairs = _side(hot.join(open_, "token", "left_semi"), 1, "component").join(_side(hot, 2, "component"), "token").filter(
        f"digest_1 < digest_2 AND component_1 <> component_2 AND {_close_columns(num, den)}")
    return _by_token(held).mapInArrow(lean(crossed), "a long, b long").unionByName(pairs.select(F.col("digest_1").alias("a"), F.col("digest_2").alias("b")))
