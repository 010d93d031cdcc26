"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary training texts, share their backoff:
how many different words a word follows, and how often a pair that a word begins
is left to it, both over the two classes together. A rare expression, discounted
to nothing in either class, so counts for neither, and how much was read of a
class doesn't tell for it.
A text's score is the difference of the two log-likelihoods per word, turned
into a probability by a logistic curve fitted on training texts that the counts
left out. An expression (a word and the one before it) counts once in a text, in
training and in scoring: a word repeated a hundred times is no hundred witnesses.
A ratio is shrunk by how far the two counts are from chance, so that the many
words which say nothing don't drown the few that do; those shrunk to nothing
need no place in the model that workers get, whatever the vocabulary. A word
that was never seen says nothing: the classes' own shares of unseen words differ
by how much was read of each, not by what was said.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumforge.llm.common import clashing, in_fold, sized, written
from albumforge.llm.encode import string_blocks
from albumforge.llm.language import words_of
from albumforge.llm.shingles import mixed
from albumforge.llm.workers import lean

#: Taken off each count and given to backoff. Standard deviations from chance up to which a ratio is none.
DISCOUNT, CHANCE = 0.75, 3.0
#: Bounds of what the driver and workers hold: entries of each kind (16 bytes each; more stay in tables that texts are joined to); texts that the curve is fitted on.
MOST_ENTRIES, MOST_FITTED = 1_000_000, 20_000
BLOCK = 2 << 20


def expressions(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word and the word before (0 for a text's first) of each distinct expression of a block; words as 64-bit hashes."""
    distinct, index, doc = words_of(texts)
    hashes = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False).astype(object), categorize=False) | np.uint64(1)
    word = hashes[index]
    before = np.zeros(len(word), np.uint64)
    same = doc[1:] == doc[:-1]
    before[1:][same] = word[:-1][same]
    first = np.unique(mixed(pair_ids(before, word) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 7), return_index=True)[1]
    return doc[first], word[first], before[first]


def pair_ids(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(before, 1) + word, 2)


def _counted(labelled: DataFrame, pairs: bool) -> DataFrame:
    """before (pairs only), word, n0, n1: in how many texts of each class (columns text, label) each stands."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in string_blocks(batch.column(0), BLOCK):
                label = batch.column(1).slice(lo, len(texts)).to_numpy(zero_copy_only=False).astype(np.int64)
                doc, word, before = expressions(texts)
                if pairs:
                    some = before > 0
                    doc, word, before = doc[some], word[some], before[some]
                    key = pair_ids(before, word)
                else:
                    once = np.unique(mixed(word + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 8), return_index=True)[1]
                    doc, word = doc[once], word[once]
                    key = word
                _, first, at = np.unique(key, return_index=True, return_inverse=True)
                toxic = label[doc] == 1
                out = {"word": word[first].view(np.int64), "n0": np.bincount(at[~toxic], minlength=len(first)), "n1": np.bincount(at[toxic], minlength=len(first))}
                yield pa.RecordBatch.from_pydict({"before": before[first].view(np.int64), **out} if pairs else out)

    keys = ["before", "word"] if pairs else ["word"]
    schema = ", ".join(f"{k} long" for k in keys) + ", n0 long, n1 long"
    return labelled.select("text", "label").mapInArrow(lean(count), schema).groupBy(*keys).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def shrinkage(share: float) -> Column:
    """0 (chance) to 1 for the counts n0 and n1, ``share`` being the second class's part of all."""
    n = F.col("n0") + F.col("n1")
    square = (F.col("n1") - n * share) * (F.col("n1") - n * share) / F.greatest(n * (share * (1 - share)), F.lit(1e-9))
    return F.greatest(F.lit(0.0), 1 - CHANCE**2 / F.greatest(square, F.lit(1e-9)))


class Model:
    """Log-likelihood ratios that are not 0, of words and of pairs, by 64-bit ids in ascending order."""

    def __init__(self, words: pd.DataFrame, pairs: pd.DataFrame):
        second, first = (pairs[c].to_numpy(np.int64).view(np.uint64) for c in ("word", "before"))
        tables = ((words["word"].to_numpy(np.int64).view(np.uint64), words["ratio"].to_numpy(float)), (pair_ids(first, second), pairs["ratio"].to_numpy(float)))
        self.words, self.pairs = ((ids[by], ratio[by]) for ids, ratio in tables for by in [np.argsort(ids)])

    @staticmethod
    def _looked_up(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
        if not len(table[0]):
            return np.zeros(len(ids))
        at = np.minimum(np.searchsorted(table[0], ids), len(table[0]) - 1)
        return np.where(table[0][at] == ids, table[1][at], 0.0)

    def ratios(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log ratios and number of distinct expressions of each text."""
        doc, word, before = expressions(texts)
        own = self._looked_up(self.pairs, pair_ids(before, word))
        # A pair whose own counts are chance, or were never seen, says what its word says: the way back to it is shared.
        ratio = np.where(own != 0, own, self._looked_up(self.words, word))
        return np.bincount(doc, ratio, len(texts)), np.bincount(doc, minlength=len(texts))


class Tables:
    """The same ratios where they are too many for a worker: ``words`` (word, ratio) and ``pairs`` (before, word, ratio)."""

    def __init__(self, words: DataFrame, pairs: DataFrame):
        self.words, self.pairs = words, pairs


def train(labelled: DataFrame) -> Model | Tables:
    """A model from the columns text and label (1: toxic). All words and pairs of all rows are counted, in tables; the driver gets totals and the entries that say something,
    unless these are more than MOST_ENTRIES of a kind: then all of them stay tables."""
    d = DISCOUNT
    words = written(_counted(labelled, pairs=False), "toxic-words")
    pairs = written(_counted(labelled, pairs=True), "toxic-pairs")
    total = words.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"n{c}"), F.lit(0)).alias(f"n{c}") for c in (0, 1)],
                      *[F.coalesce(F.sum(F.least(f"n{c}", F.lit(d))), F.lit(0.0)).alias(f"f{c}") for c in (0, 1)]).first()
    share = total["n1"] / max(1, total["n0"] + total["n1"])
    # What a word does in pairs: as the second, how many others it follows; as the first, its counts and what it frees.
    sides = F.array(F.struct(F.col("word").alias("w"), F.lit(1).alias("follows"), *[F.lit(0).alias(f"h{c}") for c in (0, 1)]),
                    F.struct(F.col("before").alias("w"), F.lit(0).alias("follows"), *[F.col(f"n{c}").alias(f"h{c}") for c in (0, 1)]))
    in_pairs = written(pairs.select(F.inline(sides)).groupBy("w").agg(
        F.sum("follows").alias("follows"), *[F.sum(f"h{c}").alias(f"h{c}") for c in (0, 1)],
        *[F.sum(F.least(f"h{c}", F.lit(d))).alias(f"r{c}") for c in (0, 1)]), "toxic-sides")
    follows = in_pairs.agg(F.coalesce(F.sum("follows"), F.lit(0))).first()[0]
    known = words.join(in_pairs.withColumnRenamed("w", "word"), "word", "left")
    shared = (F.coalesce(F.col("follows"), F.lit(0)) + 0.5) / (follows + 0.5 * max(1, total["n"]))

    def unigram(c: int) -> Column:
        return (F.greatest(F.col(f"n{c}") - d, F.lit(0.0)) + max(1.0, total[f"f{c}"]) * shared) / max(1, total[f"n{c}"])

    rest = (F.col("r0") + F.col("r1")) / F.greatest(F.col("h0") + F.col("h1"), F.lit(1))
    by_word = written(known.select("word", "n0", "n1", "h0", "h1", *[unigram(c).alias(f"u{c}") for c in (0, 1)], rest.alias("rest")), "toxic-model")

    def saying(rows: DataFrame) -> DataFrame:
        """Rows that are not chance."""
        return rows.withColumn("weight", shrinkage(share)).filter("weight > 0")

    own = saying(by_word).select("word", (F.log(F.col("u1") / F.col("u0")) * F.col("weight")).alias("ratio"))
    second, first = by_word.select("word", "u0", "u1"), by_word.select(F.col("word").alias("before"), "h0", "h1", "rest")
    joined = saying(pairs).join(second, "word").join(first, "before")
    p = [F.greatest(F.col(f"n{c}") - d, F.lit(0.0)) / F.greatest(F.col(f"h{c}"), F.lit(1)) + F.col("rest") * F.col(f"u{c}") for c in (0, 1)]
    both = joined.select("before", "word", (F.log(p[1] / p[0]) * F.col("weight")).alias("ratio"))
    own, both = written(own, "toxic-own"), written(both, "toxic-both")
    if max(own.count(), both.count()) > MOST_ENTRIES:
        return Tables(own, both)
    return Model(own.toPandas(), both.toPandas())


def joined_ratios(texts: DataFrame, model: Tables, carried: list[str]) -> DataFrame:
    """The columns ``carried``, with total and n: what ``Model.ratios`` gives for each row's ``text``, by joins to the tables."""
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in carried)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, block in string_blocks(batch.column(0), BLOCK):
                doc, word, before = expressions(block)
                by = np.argsort(doc, kind="stable")
                ends = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=len(block)))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v[by].view(np.int64))) for v in (word, before)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i + 1).slice(lo, len(block)) for i in range(len(carried))], *lists], names=[*carried, "words", "befores"])

    begun = texts.select("text", *carried).mapInArrow(lean(listed), f"{kinds}, words array<long>, befores array<long>")
    # Written with its numbers, which the joins come back to.
    begun = written(begun.withColumn("row", F.monotonically_increasing_id()), "toxic-begun")
    each = begun.select("row", F.explode(F.arrays_zip("words", "befores")).alias("e")).select("row", F.col("e.words").alias("word"), F.col("e.befores").alias("before"))
    told = each.join(model.pairs.withColumnRenamed("ratio", "_pair"), ["before", "word"], "left").join(model.words.withColumnRenamed("ratio", "_word"), "word", "left")
    totals = told.groupBy("row").agg(F.sum(F.coalesce(F.nullif("_pair", F.lit(0.0)), "_word", F.lit(0.0))).alias("total"))
    return begun.select(*carried, "row", F.size("words").cast("long").alias("n")).join(totals, "row", "left").select(*carried, F.coalesce("total", F.lit(0.0)).alias("total"), "n")


def features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the curve sees: the ratio per word, and the same against the noise that a text of this length has."""
    per_word = total / np.maximum(1, n)
    return np.stack([per_word * 20, per_word * np.sqrt(n), np.ones(len(n))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, counted: DataFrame, fitted: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``.

    ``counted`` and ``fitted`` (text, label): labelled rows for the counts and
    for the curve, none in both; of ``fitted``, rows that share a ``key`` count
    once. Null and empty texts get the score of a text that says nothing. Without
    rows in ``fitted``, or with one class only, the curve keeps to that class's
    share. Null ids and equal rows stay, very long texts are one block each, and
    other columns are left out.
    """
    sc = docs.sparkSession.sparkContext
    trained = train(counted)
    joined = isinstance(trained, Tables)
    model = sc.broadcast(None if joined else trained)
    text = clashing(docs, id_column, text_column).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = text.schema["doc_id"].dataType.simpleString()
    if "key" not in fitted.columns:
        fitted = fitted.withColumn("key", F.monotonically_increasing_id())

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in string_blocks(batch.column(0), BLOCK):
                total, n = model.value.ratios(texts)
                yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(n.astype(np.int64)), batch.column(1).slice(lo, len(texts)).cast(pa.int32()), batch.column(2).slice(lo, len(texts))],
                                                 names=["total", "n", "label", "key"])

    # By hash of the key, so that no task has to gather texts: about MOST_FITTED rows, all of them where there are no more.
    sample = fitted.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.lit(1e6 * MOST_FITTED / max(1, fitted.count())))
    if joined:
        found = joined_ratios(sample.select("text", F.col("label").cast("int").alias("label"), "key"), trained, ["label", "key"])
    else:
        found = sample.select("text", "label", "key").mapInArrow(lean(ratios), "total double, n long, label int, key long")
    rows = found.dropDuplicates(["key", "label"]).toPandas().sort_values(["total", "n", "label"])
    x, y = features(rows["total"].to_numpy(float), rows["n"].to_numpy(float)), rows["label"].to_numpy(float)
    weights = sc.broadcast(logistic(x, y))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in string_blocks(batch.column(1), BLOCK):
                z = features(*model.value.ratios(texts)) @ weights.value
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    def curved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = features(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))) @ weights.value
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    if joined:
        return joined_ratios(text, trained, ["doc_id"]).mapInArrow(lean(curved), f"doc_id {kind}, score double")
    return text.mapInArrow(lean(score), f"doc_id {kind}, score double")


def held_out_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
                      least: float = 0.3) -> DataFrame:
    """``toxicity`` of all rows, learned from those whose crc32 of the id leaves 0 or 1 (counts) or 3 (curve) modulo 4.

    A label holds for every row of its id: rows that share one are counted each,
    but fit the curve once for each different text.
    """
    said = sized(labels.select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("label")).filter("_id IS NOT NULL AND label IN (0, 1)").distinct())
    rows = clashing(docs, id_column, text_column).filter(F.col(text_column).isNotNull() & ~in_fold(F.col(id_column), 4, 2))
    known = rows.join(said, rows[id_column] == said["_id"]).select(
        F.col(text_column).alias("text"), "label", in_fold(F.col("_id"), 4, 3).alias("fit"), F.xxhash64("_id", text_column).alias("key"))
    scored = toxicity(docs, known.filter("NOT fit").select("text", "label"), known.filter("fit").select("text", "label", "key"), id_column, text_column)
    return scored.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
