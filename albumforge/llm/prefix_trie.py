"""The prefix trie of conversations, with prefixes that nobody shares screened out by a count-min sketch.

A prefix is known by the exclusive or of hashes of its turns, each tagged with
its place, so prefixes of a conversation that spans many tasks are put together
from one row per task. A sketch over all prefixes then proves most of them
singletons: an estimate of one is never too low. From a conversation's first
singleton on, its tail is emitted where it stands; only prefixes that may be
shared are shuffled and grouped exactly.

Sums over subtrees need no walk. The smallest member of a node owns it, and a
conversation owns its path from some depth on: so a node's children, leaves and
saved bytes are sums over its members of what each owns below.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumforge.llm.common import clashing, scanned, written
from albumforge.llm.workers import lean
from albumforge.session import shared_dir

#: Bits of a sketch (64 MB in each worker); cells of each of its two rows per prefix; rows counted together before they are sent.
MOST_CELLS, CELLS_EACH, FLUSH_ROWS, CHUNK = 1 << 29, 4, 1 << 20, 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(conversations: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, depth, length of the whole, digest, bytes), and all conversations with that length."""
    c = clashing(conversations, "conv_id", "turn", "role", "text")
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    said = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = c.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), said.alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
                                                          F.lit(1).cast("long").alias("place"), F.monotonically_increasing_id().alias("key"))
    own = scanned(written(turns, "trie-turns"), "conv", ["turn", "role", "digest", "key"], {"place": "add"}, "trie-ordered")
    own = own.select("conv", (F.col("run_place") - 1).alias("place"), "digest", "bytes")
    sizes = written(own.groupBy("conv").agg(F.count(F.lit(1)).alias("turns")), "trie-sizes")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    asked = sizes.withColumn("head", head).withColumn("base", F.col("conv") - F.col("conv") % every)
    bases = sizes.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"))
    copied = F.least("head", F.coalesce("base_turns", F.lit(0)))
    convs = asked.join(bases, "base", "left").withColumn("copied", copied)
    convs = written(convs.select("conv", "base", "head", "copied", (F.col("copied") + F.greatest(F.lit(0), F.col("turns") - F.col("head"))).alias("length")), "trie-conversations")
    # A conversation lends its first turns to a few others at most.
    lent = own.filter((F.col("conv") % every == 0) & (F.col("place") < most - 1)).withColumnRenamed("conv", "base")
    heads = lent.join(convs, "base").filter("place < copied").select("conv", (F.col("place") + 1).alias("depth"), "length", "digest", "bytes")
    rest = own.join(convs, "conv").filter("place >= head").select("conv", (F.col("place") - F.col("head") + F.col("copied") + 1).alias("depth"), "length", "digest", "bytes")
    return heads.unionByName(rest), convs.select("conv", "length")


def _counted(width: int):
    """Cells of both rows of the sketch, by chunk: those hit once and those hit more often."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            chunk = cells // CHUNK
            starts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            once, more = [], []
            for a, b in zip(starts, np.append(starts[1:], len(cells)), strict=True):
                at = (cells[a:b] % CHUNK).astype(np.uint16)
                once.append(at[n[a:b] == 1].tobytes())
                more.append(at[n[a:b] > 1].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(chunk[starts].astype(np.int64)), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["chunk", "once", "more"])

        for batch in batches:
            held.append(np.concatenate(_cells(batch.column(0), batch.column(1), width)))
            rows += batch.num_rows
            if rows >= FLUSH_ROWS:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return count


def _cells(one: pa.Array, two: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    return one.to_numpy() & (width - 1), (two.to_numpy() & (width - 1)) + width


def _merge_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    hits = np.zeros(CHUNK, np.int64)
    for column, times in (("once", 1), ("more", 2)):
        for part in pdf[column]:
            hits[np.frombuffer(part, np.uint16)] += times  # a part names a cell once
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "bits": [np.packbits(hits > 1).tobytes()]})


def sketch(prefixes: DataFrame, n: int, most_cells: int) -> tuple[np.ndarray, int]:
    """One bit for each cell of a count-min sketch with two rows: whether its count passes one. The width grows with ``n`` up to ``most_cells`` / 2."""
    width = min(most_cells // 2, max(CHUNK, 1 << (CELLS_EACH * n - 1).bit_length()))
    parts = prefixes.select("one", "two").mapInArrow(lean(_counted(width)), "chunk long, once binary, more binary")
    bits = np.zeros(2 * width // 8, np.uint8)
    for r in parts.groupBy("chunk").applyInPandas(_merge_cells, "chunk long, bits binary").toLocalIterator():
        part = bits[r["chunk"] * CHUNK // 8:(r["chunk"] + 1) * CHUNK // 8]
        part[:] = np.frombuffer(r["bits"], np.uint8)[:len(part)]
    return bits, width


def screened(prefixes: DataFrame, n: int, most_cells: int) -> DataFrame:
    """``prefixes`` with ``single`` (proven so, itself or a shorter prefix of its conversation) and ``top`` (the one before it isn't known to be)."""
    bits, width = sketch(prefixes, n, most_cells)
    shared = prefixes.sparkSession.sparkContext.broadcast(bits)
    at = {name: i for i, (name, _) in enumerate(prefixes.dtypes)}

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last, known = shared.value, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            hit = np.ones(batch.num_rows, bool)
            for cells in _cells(batch.column(at["one"]), batch.column(at["two"]), width):
                hit &= (table[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
            conv, depth = batch.column(at["conv"]).to_numpy(), batch.column(at["depth"]).to_numpy()
            new = np.append(last != (conv[0], depth[0] - 1), (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1] + 1))
            alone = ~hit
            if not new[0] and known:
                alone[0] = True
            seen, starts = np.cumsum(alone), np.flatnonzero(new)
            base = np.zeros(len(new), np.int64)
            base[starts] = np.diff(np.append(0, seen[starts] - alone[starts]))
            single = seen > np.cumsum(base)
            before = np.append(known and not new[0], single[:-1] & ~new[1:])
            last, known = (conv[-1], depth[-1]), bool(single[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single), pa.array(single & ~before)], names=[*batch.schema.names, "single", "top"])

    return prefixes.mapInArrow(lean(screen), ", ".join(f"{n} {k}" for n, k in prefixes.dtypes) + ", single boolean, top boolean")


_KEY = ["one", "two", "depth"]


def ends(members: DataFrame) -> DataFrame:
    """one, two, depth and ends_sha256 of the conversations (conv) that end at each node, ascending.

    Ranges of members are joined to texts side by side; SHA-256 itself runs over
    a node's texts in order, which no tree can cut, as a stream of bounded pieces.
    """
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(i).to_numpy() for i in range(4)]
            starts = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in own[:3]], axis=0)))
            joined = [",".join(map(str, x.tolist())) for x in np.split(own[3], starts[1:])]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[starts]) for c in own], pa.array(joined)], names=[*_KEY, "conv", "text"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        result = lambda: pa.RecordBatch.from_pylist([dict(zip([*_KEY, "ends_sha256"], [*node, state.hexdigest()], strict=True))], schema=_ENDS)
        for batch in batches:
            for one, two, depth, text in zip(*[batch.column(c).to_pylist() for c in (*_KEY, "text")], strict=True):
                if (one, two, depth) != node:
                    if node is not None:
                        yield result()
                    node, state = (one, two, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
        if node is not None:
            yield result()

    order = [*_KEY, "conv"]
    parts = members.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(texts, "one long, two long, depth long, conv long, text string")
    return parts.repartition(*_KEY).sortWithinPartitions(*order).mapInArrow(folded, "one long, two long, depth long, ends_sha256 string")


_ENDS = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def prefix_trie(conversations: DataFrame, every: int = 5, most: int = 9, most_cells: int = MOST_CELLS) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations: the columns of ``NODE``.

    Turns of a conversation are ordered by turn (null first), then role, then a
    digest of both texts; null role or text is empty, and equal rows are turns of
    their own. Rows with a null conv_id take no part; other columns are left out.
    No conversation: an empty result, without a root. Turns and prefixes are
    known by 128 bits. Prefixes beyond ``most_cells`` / 8 are screened in
    several passes, each over the conversations that begin alike; one beginning
    with more than that weakens the screen only, and grouping stays exact.
    """
    spark = conversations.sparkSession
    turns, convs = rebuilt(conversations, every, most)
    totals = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("root"), F.coalesce(F.sum("length"), F.lit(0)).alias("rows"), F.max("length").alias("longest")).first()
    if not totals["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    root = totals["root"]
    tagged = turns.select("conv", "depth", "length", "bytes", F.xxhash64(F.lit(1), "depth", "digest").alias("one"), F.xxhash64(F.lit(2), "depth", "digest").alias("two"),
                          F.xxhash64(F.lit(3), "digest").alias("group"))
    run = scanned(tagged, "conv", ["depth"], {"one": "xor", "two": "xor", "bytes": "add", "group": "first"}, "trie-prefixes")
    passes = max(1, -(-totals["rows"] // (most_cells // (2 * CELLS_EACH))))
    prefixes = run.select("conv", "depth", "length", F.col("run_one").alias("one"), F.col("run_two").alias("two"), (F.col("run_bytes") - F.col("bytes")).alias("before"), "bytes",
                          F.pmod("run_group", F.lit(passes)).cast("int").alias("pass"))
    place = f"{shared_dir(spark)}/llm/trie-{uuid.uuid4().hex}"
    prefixes.sortWithinPartitions("pass", "conv", "depth").write.partitionBy("pass").parquet(f"{place}/prefixes")
    schema = prefixes.drop("pass").schema
    stored = spark.read.schema(prefixes.schema).parquet(f"{place}/prefixes")
    counts = {r["pass"]: r["n"] for r in stored.groupBy("pass").agg(F.count(F.lit(1)).alias("n")).collect()} if totals["rows"] else {}
    for number, n in sorted(counts.items()):
        own = spark.read.schema(schema).parquet(f"{place}/prefixes/pass={number}")
        screened(own, n, most_cells).write.partitionBy("single").parquet(f"{place}/screened/pass={number}")
    seen = spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in prefixes.drop("pass").dtypes) + ", top boolean, single boolean")
    if counts:
        seen = spark.read.schema(seen.schema).parquet(f"{place}/screened")

    # What may be shared: exact groups, and back to their members.
    maybe = seen.filter("NOT single")
    groups = maybe.groupBy(*_KEY).agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("members"), F.max("length").alias("longest")).filter("members > 1")
    # Written, so that the join has a shuffle of its own, whose hot prefixes the planner can cut.
    groups = written(groups, "trie-groups")
    member = written(maybe.drop("single", "top").join(groups, _KEY, "left"), "trie-members")
    shared, alone = member.filter("owner IS NOT NULL"), member.filter("owner IS NULL")
    # The deepest node that a conversation doesn't own, and whether its end is another's or goes on.
    foreign = F.when(F.col("owner") != F.col("conv"), F.struct("depth", (F.col("before") + F.col("bytes")).alias("bytes"), "owner"))
    inner = (F.col("depth") == F.col("length")) & ((F.col("owner") != F.col("conv")) | (F.col("longest") > F.col("length")))
    met = shared.groupBy("conv").agg(F.max(foreign).alias("above"), F.max(inner).alias("inner"))
    owns = written(convs.join(met, "conv", "left").select(
        "conv", "length", (F.coalesce(F.col("above.depth"), F.lit(0)) + 1).alias("owned"), F.coalesce(F.col("above.bytes"), F.lit(0)).alias("saved"),
        F.coalesce(F.col("above.owner"), F.lit(root)).alias("parent"), (~F.coalesce("inner", F.lit(False)) & (F.col("length") > 0)).cast("long").alias("leaf")), "trie-owners")
    of = owns.drop("length")
    parent = F.when(F.col("depth") > F.col("owned"), F.col("conv")).otherwise(F.col("parent"))
    child = (F.col("owned") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))
    nodes = shared.join(of, "conv").groupBy(*_KEY).agg(
        F.min("conv").alias("conv_id"), F.max(F.when(F.col("conv") == F.col("owner"), parent)).alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.lit(0), F.col("saved") - F.col("before"))).alias("saved_tokens"))
    top = owns.agg(F.min("conv").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"),
                   F.sum(((F.col("owned") <= 1) & (F.col("length") > 0)).cast("long")).alias("n_children"),
                   (F.sum("leaf") if totals["longest"] else F.lit(1).cast("long")).alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    ended = shared.filter("depth = length").select(*_KEY, "conv").unionByName(convs.filter("length = 0").select(zero.alias("one"), zero.alias("two"), zero.alias("depth"), "conv"))
    grouped = nodes.unionByName(top.select(zero.alias("one"), zero.alias("two"), zero.alias("depth"), "*")).join(ends(ended), _KEY, "left")
    grouped = grouped.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))

    def lone(rows: DataFrame, above: Column) -> DataFrame:
        """Nodes of one conversation."""
        last = F.col("depth") == F.col("length")
        return rows.select(F.col("conv").alias("conv_id"), "depth", above.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (~last).cast("long").alias("n_children"),
                           F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(EMPTY).alias("ends_sha256"))

    tails = lone(seen.filter("single AND NOT top"), F.col("conv"))
    firsts = seen.filter("single AND top").select("conv", "depth", "length").unionByName(alone.select("conv", "depth", "length"))
    return grouped.select(*NODE).unionByName(tails).unionByName(lone(firsts.join(of, "conv"), parent))
