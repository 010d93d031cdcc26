"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of hashed features: its words, the shapes of its words and of
neighbouring words, and repetition. A bounded, labelled sample gives inverse
document frequencies and a truncated singular value decomposition. Every
document is put into that space, block by block, its cosine with every labelled
vector is computed, and the nearest vote by similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from albumforge.llm.common import clashing, fresh, in_fold, sized
from albumforge.llm.encode import string_blocks
from albumforge.llm.workers import lean

#: Hashed features, rank of the space, labelled vectors of each class, neighbours that vote.
FEATURES, RANK, EACH_CLASS, NEIGHBOURS = 4096, 48, 2048, 15
REPEATED = 8.0
#: Bytes and rows of texts handled at a time: a block's bags are a dense matrix of rows by features.
BLOCK, BLOCK_ROWS = 1 << 19, 256


def _hashed(strings: pa.Array, salt: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(s.encode(), salt) % FEATURES for s in strings.to_numpy(zero_copy_only=False)), np.int64, len(strings))


def bags(texts: pa.Array) -> np.ndarray:
    """Texts by features: log(1 + count)."""
    split = pc.split_pattern_regex(texts, r"[ \t-\r]+")
    flat, counts = split.flatten(), np.diff(split.offsets.to_numpy())
    doc = np.repeat(np.arange(len(texts)), counts)
    coded = flat.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary
    shapes = words
    for pattern, letter in ((r"\p{Lu}{2,}", "A"), (r"\p{Ll}+", "a"), (r"\p{N}+", "0"), (r"([^\p{L}\p{N}])[^\p{L}\p{N}]+", r"\1\1")):
        shapes = pc.replace_substring_regex(shapes, pattern, letter)
    shape_code = shapes.dictionary_encode()
    shape = _hashed(shape_code.dictionary, 1)[shape_code.indices.to_numpy(zero_copy_only=False)][index]
    word = _hashed(pc.utf8_lower(words), 2)[index]
    blank = pc.equal(words, "").to_numpy(zero_copy_only=False)[index]
    next_ = doc[1:] == doc[:-1]
    two = ((shape[:-1] * 31 + shape[1:] * 17 + 5) % FEATURES)[next_]
    columns = np.concatenate([word[~blank], shape[~blank], two])
    rows = np.concatenate([doc[~blank], doc[~blank], doc[1:][next_]])
    out = np.log1p(np.bincount(rows * FEATURES + columns, minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES).astype(np.float32))
    # How much of a text says the word before again: three features of a weight that no single word reaches.
    again = np.bincount(doc[1:][next_ & (index[1:] == index[:-1])], minlength=len(texts)) / np.maximum(1, counts - 1)
    some = np.flatnonzero(np.bincount(doc[~blank], minlength=len(texts)))
    out[some, np.searchsorted([0.05, 0.2], again[some])] += REPEATED
    return out


class Space:
    """Weights of features, the projection, and the labelled vectors with their votes."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rank: int = RANK):
        n = len(x)
        self.labels = labels.astype(np.float32)
        self.idf = np.log((1 + n) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.1
        unit = self._unit(x * self.idf)
        # A randomised range finder: two passes over the sample's matrix and one small decomposition.
        start = np.random.default_rng(0).normal(size=(FEATURES, min(rank + 16, n))).astype(np.float32)
        basis = np.linalg.qr(unit @ start)[0]
        basis = np.linalg.qr(unit @ (unit.T @ basis))[0]
        right = np.linalg.svd(basis.T @ unit, full_matrices=False)[2][:rank].T.astype(np.float32)
        self.projection = right * self.idf[:, None]
        self.vectors = self._unit(unit @ right)
        self.prior = float(labels.mean()) if n else 0.0

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, texts: pa.Array, neighbours: int = NEIGHBOURS) -> np.ndarray:
        near = self._unit(bags(texts) @ self.projection) @ self.vectors.T
        k = min(neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** 4
        # A little of the prior: a text that is like nothing seen gets just that.
        return np.clip(((weight * self.labels[top]).sum(axis=1) + 1e-3 * self.prior) / (weight.sum(axis=1) + 1e-3), 0, 1)


def fit(sample: DataFrame) -> Space | None:
    """The space of a bounded sample (columns text, label): its bags reach the driver as sparse rows."""
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in string_blocks(batch.column(0), BLOCK, BLOCK_ROWS):
                x = bags(texts)
                at = [np.flatnonzero(row) for row in x]
                yield pa.RecordBatch.from_arrays([pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()), pa.array([row[a].tobytes() for row, a in zip(x, at, strict=True)], pa.binary()),
                                                  batch.column(1).slice(lo, len(texts)).cast(pa.int32())], names=["at", "x", "label"])

    rows = sample.select("text", "label").mapInArrow(lean(sparse), "at binary, x binary, label int").collect()
    if not rows:
        return None
    # The order that rows came in must not matter.
    rows.sort(key=lambda r: (bytes(r["at"]), bytes(r["x"]), r["label"]))
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["x"], np.float32)
    return Space(x, np.array([r["label"] for r in rows]))


def scored(docs: DataFrame, sample: DataFrame, text_column: str, name: str) -> DataFrame:
    """``docs``, all columns, with the score ``name`` of each row."""
    space = docs.sparkSession.sparkContext.broadcast(fit(sample))
    at = docs.columns.index(text_column)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in string_blocks(batch.column(at), BLOCK, BLOCK_ROWS):
                own = space.value.score(texts) if space.value else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, len(texts)).columns, pa.array(own, pa.float64())], names=[*docs_columns, name])

    docs_columns = docs.columns
    return docs.mapInArrow(lean(score), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_votes(docs: DataFrame, sample: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: good likelier) of every row of ``docs``; ``sample`` (text, label) must be bounded.

    Null and empty texts have no features: they get the sample's share of good
    texts, as does every text when the sample is empty (0 then). Very long texts
    are one block each. Null ids and equal rows stay; other columns are left out.
    """
    text = clashing(docs, id_column, text_column).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return scored(text, sample, "text", "score").select("doc_id", "score")


def drawn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", each_class: int = EACH_CLASS) -> DataFrame:
    """text and label of at most ``each_class`` ids of each label whose crc32 leaves no 0 modulo 5; one text of each id, whatever rows share it."""
    said = labels.select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("label")).filter(
        F.col("_id").isNotNull() & F.col("label").isin(0, 1) & ~in_fold(F.col("_id"), 5, 0)).distinct()
    picked = [said.filter(F.col("label") == k).orderBy(F.xxhash64("_id"), "_id").limit(each_class) for k in (0, 1)]
    rows = clashing(docs, id_column, text_column)
    chosen = sized(picked[0].unionByName(picked[1]))
    known = rows.join(chosen, rows[id_column] == chosen["_id"]).filter(F.col(text_column).isNotNull())
    return known.groupBy("_id", "label").agg(F.min_by(F.col(text_column), F.struct(F.xxhash64(text_column), F.length(text_column))).alias("text")).select("text", "label")


def held_out_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
                     each_class: int = EACH_CLASS, least: float = 0.3) -> DataFrame:
    """``quality_votes`` of all rows, learned from ``drawn`` labelled texts."""
    voted = quality_votes(docs, drawn(docs, labels, id_column, text_column, label_column, each_class), id_column, text_column)
    return voted.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def good_rows(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, each judged by its own text, whose score is at least ``least``."""
    name = fresh(docs, "score")
    return scored(docs, drawn(docs, labels), "text", name).filter(F.col(name) >= least).drop(name)
