"""A Merkle manifest of a dataset: leaves per source, one tree over the sources, and a proof for every row.

Digests are narrow rows; texts are read once. Trees are cut into superblocks of
16^3 consecutive nodes. Going up, each superblock is reduced to its root, and
these roots are the nodes of the next tier, until each tree has one. Going down,
the leaves of a superblock and the outer nodes that their proofs need are
cogrouped: the local reduction is done again next to the proofs, the outer part
is joined to them, and the (tampered) leaf is folded up to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumforge.llm.common import clashing, numbered, written

#: Children of a node, and levels of a superblock.
FAN, LEVELS = 16, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX = 64


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def encoded(values: list[Column]) -> Column:
    """Each value as its UTF-8 byte count, a colon and itself; null as ``-``."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def leaves(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """doc_id, source, leaf and changed (the leaf after tampering, null where none was tried or nothing changed); digests in 32 bytes."""
    own = [docs[c] for c in columns]
    leaf = F.unhex(F.sha2(encoded(own), 256))
    touched = [F.translate(c, _UPPER, _LOWER) if name == columns[-1] else c for c, name in zip(own, columns, strict=True)]
    changed = F.when(F.lit(False) if tampered is None else tampered & (touched[-1] != own[-1]), F.unhex(F.sha2(encoded(touched), 256)))
    return docs.select(own[0].alias("doc_id"), own[1].alias("source"), leaf.alias("leaf"), changed.alias("changed"))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with tree (number of the source), n and start (the tree's leaves, and those of trees before it) and pos in the tree; and the trees."""
    # A key of its own for each row lets rows that are equal in all else be cut anywhere.
    keyed = written(rows.withColumn("_key", F.monotonically_increasing_id()), "merkle-leaves")
    order = ["source", "doc_id", "leaf", "_key"]
    dealt = written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_key").withColumn("_row", F.monotonically_increasing_id()), "merkle-ordered")
    part = F.shiftright("_row", 33)
    # One row for each source and range: a task's rows of a source stand side by side.
    ranges = dealt.groupBy(part.alias("_part"), "source").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = written(ranges.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))), "merkle-ranges")
    sources = ranges.groupBy("source").agg(F.sum("_n").alias("n")).withColumn("_one", F.lit(1))
    trees = numbered(numbered(sources, ["source"], "_one", "tree", "merkle-sources"), ["tree"], "n", "start", "merkle-starts").select("source", "tree", "n", "start")
    trees = written(trees, "merkle-trees")
    named = ranges.join(trees, ranges["source"].eqNullSafe(trees["source"])).select("_part", trees["source"].alias("_source"), "tree", "n", "start", (F.col("_base") - F.col("_first")).alias("_shift"))
    rows = dealt.withColumn("_part", part).alias("d").join(named.alias("r"), (F.col("d._part") == F.col("r._part")) & F.col("d.source").eqNullSafe(F.col("r._source")))
    return rows.select("doc_id", F.col("leaf").alias("digest"), "changed", "tree", "n", "start", (F.col("_row") + F.col("_shift")).alias("pos")), trees


def superblocks(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with the key of its superblock: a tree's run of 16^levels nodes, or a bundle of whole small trees."""
    small = F.col("n") <= FAN**levels
    return nodes.withColumn("big", F.when(small, -1).otherwise(F.col("tree"))).withColumn("run", F.floor(F.when(small, F.col("start")).otherwise(F.col("pos")) / FAN**levels))


class Local:
    """The levels of one superblock's part of a tree: up to the root of a small tree, else ``levels`` of them."""

    def __init__(self, digests: list[str], small: bool, levels: int):
        self.runs: list[list[str]] = []  # by level, the joined digests of each run
        while len(digests) > 1 if small else len(self.runs) < levels:
            runs = ["".join(digests[i:i + FAN]) for i in range(0, len(digests), FAN)]
            digests = [digest(r) for r in runs]
            self.runs.append(runs)
        self.root = digests[0]

    def path(self, place: int) -> Iterator[tuple[str, str]]:
        """Joined siblings to the left and to the right, level by level."""
        for runs in self.runs:
            run, at = runs[place // FAN], place % FAN * _HEX
            yield run[:at], run[at + _HEX:]
            place //= FAN


def _trees(pdf: pd.DataFrame, levels: int) -> Iterator[tuple[pd.DataFrame, Local]]:
    for _, own in pdf.sort_values(["tree", "pos"], kind="stable").groupby("tree"):
        yield own, Local([d.hex() for d in own["digest"]], own["n"].iloc[0] <= FAN**levels, levels)


_NODE = "digest binary, tree long, n long, start long, pos long"


def _reduce(pdf: pd.DataFrame, levels: int) -> pd.DataFrame:
    out = []
    for own, local in _trees(pdf, levels):
        n, start, pos = (int(own[c].iloc[0]) for c in ("n", "start", "pos"))
        out.append((bytes.fromhex(local.root), own["tree"].iloc[0], -(-n // FAN**levels), start // FAN**levels, pos // FAN**levels))
    return pd.DataFrame(out, columns=["digest", "tree", "n", "start", "pos"])


def climb(nodes: DataFrame, most: int, levels: int, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each tier (superblock keys added), and every tree's root; ``most``: leaves of the largest tree."""
    tiers, roots = [], None
    while True:
        keyed = superblocks(nodes, levels)
        tiers.append(keyed)
        up = written(keyed.select("big", "run", "digest", "tree", "n", "start", "pos").groupBy("big", "run").applyInPandas(lambda pdf: _reduce(pdf, levels), _NODE), f"merkle-{tag}{len(tiers)}")
        done = up.filter("n = 1").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        if most <= FAN**levels:
            return tiers, roots
        nodes, most = up.filter("n > 1"), -(-most // FAN**levels)


_OUTER = "tree long, pos long, subroot string, lefts array<string>, rights array<string>"


def _inner(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Whole paths of a tier's nodes, which are the outer ones of the tier below."""
    above = {r.tree: r for r in outer.itertuples()}
    out = []
    for own, local in _trees(nodes, levels):
        up = above[own["tree"].iloc[0]]
        for place, pos in enumerate(own["pos"]):
            path = list(local.path(place))
            out.append((up.tree, pos, up.subroot, [p[0] for p in path] + list(up.lefts), [p[1] for p in path] + list(up.rights)))
    return pd.DataFrame(out, columns=["tree", "pos", "subroot", "lefts", "rights"])


_PROVED = "doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string"


def _prove(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    above = {r.tree: r for r in outer.itertuples()}
    out = []
    for own, local in _trees(nodes, levels):
        up = above[own["tree"].iloc[0]]
        beyond = list(zip(up.lefts, up.rights, strict=True))
        for place, (doc_id, leaf, changed) in enumerate(zip(own["doc_id"], own["digest"], own["changed"], strict=True)):
            path = [*local.path(place), *beyond]
            folded = (leaf if changed is None else changed).hex()
            for left, right in path:
                folded = digest(left + folded + right)
            out.append((doc_id, leaf.hex(), up.subroot, digest("".join(left + right for left, right in path)), folded))
    return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


def descend(tiers: list[DataFrame], roots: DataFrame, levels: int, last: bool) -> DataFrame:
    """From the outer paths of the trees' roots (tree, subroot, lefts, rights) to those of all nodes of the lowest tier, or (``last``) to its rows' proofs."""
    below: DataFrame | None = None
    for tier in reversed(range(len(tiers))):
        nodes = tiers[tier]
        # A small tree's outer nodes are those of its root; a large one's come from the tier above, one row for each superblock.
        small = nodes.filter("big = -1").select("tree", "big", "run").distinct()
        outer = small.join(roots, "tree").select(F.col("big").alias("_big"), F.col("run").alias("_run"), F.col("tree").alias("tree"), F.lit(0).cast("long").alias("pos"), "subroot", "lefts", "rights")
        if below is not None:
            outer = outer.unionByName(below.select(F.col("tree").alias("_big"), F.col("pos").alias("_run"), "tree", "pos", "subroot", "lefts", "rights"))
        pairs = nodes.groupBy("big", "run").cogroup(outer.groupBy("_big", "_run"))
        if last and tier == 0:
            return pairs.applyInPandas(lambda own, up: _prove(own, up, levels), _PROVED)
        below = written(pairs.applyInPandas(lambda own, up: _inner(own, up, levels), _OUTER), "merkle-paths")
    return below


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = COLUMNS, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row; ``columns``: id, source, others, text.

    ``tampered`` tells whose text is lower-cased (A-Z) before folding; null
    means no. Null values are leaves' ``-``, so null ids (first in a source) and
    null sources (a tree of their own, first) take part. Rows with one id stand
    in the order of their leaves; equal rows are leaves of their own. Empty and
    very long texts are hashed like any other; columns besides ``columns`` are
    left out of the leaves. No rows: an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[columns[0]].dataType
    rows, trees = placed(leaves(docs, tampered, columns))
    size = trees.agg(F.count(F.lit(1)).alias("trees"), F.max("n").alias("most")).first()
    if not size["trees"]:
        return spark.createDataFrame([], f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas turns whole numbers next to a null into floats
    tiers, subroots = climb(rows, size["most"], levels, "tier")
    # One tree over the sources' roots, in their order.
    tops = subroots.select("digest", F.lit(0).cast("long").alias("tree"), F.lit(size["trees"]).cast("long").alias("n"), F.lit(0).cast("long").alias("start"), F.col("tree").alias("pos"))
    top_tiers, top_root = climb(tops, size["trees"], levels, "top")
    root = top_root.first()["digest"].hex()
    start = spark.createDataFrame([(0, root, [], [])], "tree long, subroot string, lefts array<string>, rights array<string>")
    outer = descend(top_tiers, start, levels, last=False).select(F.col("pos").alias("tree"), "lefts", "rights")
    named = subroots.select("tree", F.lower(F.hex("digest")).alias("subroot")).join(outer, "tree")
    proved = descend(tiers, named, levels, last=True)
    return proved.select(F.col("doc_id").cast(kind).alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def tampered_manifest(docs: DataFrame, every: int = 5, levels: int = LEVELS) -> DataFrame:
    """``merkle_manifest`` with tampering where ``every`` divides the crc32 of the decimal id; a null id is never touched."""
    return merkle_manifest(docs, F.crc32(docs["doc_id"].cast("string").cast("binary")) % every == 0, levels=levels)
