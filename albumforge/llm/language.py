"""Language of whole texts by word-first backoff.

A word seen in training scores by its log frequency in each language. A word
that was not scores by its longest character n-grams seen in training, falling
back to shorter ones where those are unseen. Counts are made for all training
texts and kept in tables that grow with them. Workers hold the most frequent
words; a text's other words are joined to the tables, so how many are held
changes the cost and not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumforge.llm.common import clashing, cutoff, in_fold, sized, written
from albumforge.llm.encode import string_blocks
from albumforge.llm.workers import lean

#: Longest n-gram; rates (one per entry and language) of words that workers hold, and of n-grams up to which these are broadcast.
LONGEST, HEAD_RATES, GRAM_RATES = 4, 600_000, 2_000_000
#: Mass left for what was never seen, and how much a shorter n-gram counts against a longer one.
BACKOFF = 0.4


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case letter runs of a block of texts, the place in them of each run, and the text of each run."""
    split = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+")
    flat = split.flatten()
    counts = np.diff(split.offsets.to_numpy())
    doc = np.repeat(np.arange(len(texts)), counts)
    coded = flat.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    keep = ~empty[index]
    return coded.dictionary, index[keep], doc[keep]


def _counts(labelled: DataFrame) -> DataFrame:
    """lang, word, n over all training texts (columns text, lang); each task adds up its own before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in string_blocks(batch.column(0)):
                distinct, index, doc = words_of(texts)
                lang = batch.column(1).slice(lo, len(texts)).dictionary_encode()
                code = lang.indices.to_numpy(zero_copy_only=False)[doc].astype(np.int64) * max(1, len(distinct)) + index
                own, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(own // max(1, len(distinct)))), distinct.take(pa.array(own % max(1, len(distinct)))).cast(pa.string()), pa.array(n)],
                                                 names=["lang", "word", "n"])

    return labelled.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _entries(counts: DataFrame, langs: list[str]) -> DataFrame:
    """level (0: words, k: n-grams of length k), entry, n and rates, an array of log((count + 1/2) / (all + entries / 2)) by language.

    Every word that some language has more than once and every n-gram has a
    row; an entry unknown to one language gets what half an unseen case would.
    """
    spark = counts.sparkSession
    codes = sized(spark.createDataFrame(list(enumerate(langs)), "code int, lang string"))
    coded = counts.join(codes, "lang").select("code", "word", "n")
    grams = F.expr(f"""flatten(transform(sequence(1, {LONGEST}), k -> filter(transform(sequence(1, greatest(1, length(word) + 3 - k)),
        i -> substring(concat(' ', word, ' '), i, k)), g -> length(g) = k)))""")
    of_grams = coded.select(F.explode(grams).alias("entry"), "code", "n").groupBy("entry", "code").agg(F.sum("n").alias("n")).withColumn("level", F.length("entry"))
    every = coded.filter("n > 1").select(F.col("word").alias("entry"), "code", "n", F.lit(0).alias("level")).unionByName(of_grams)
    by_entry = written(every.groupBy("level", "entry").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("own")), "language-entries")
    # The driver gets one number per level, and one per level and language.
    sizes = {r["level"]: r["count"] for r in by_entry.groupBy("level").count().collect()}
    totals = np.full((LONGEST + 1, len(langs)), 0.5) * np.array([[max(1, sizes.get(k, 0))] for k in range(LONGEST + 1)])
    for r in by_entry.select("level", F.explode("own").alias("code", "n")).groupBy("level", "code").agg(F.sum("n").alias("n")).collect():
        totals[r["level"], r["code"]] += r["n"]
    by_level = spark.createDataFrame([(k, row) for k, row in enumerate(totals.tolist())], "level int, totals array<double>")
    rates = F.transform("totals", lambda t, i: F.log((F.coalesce(F.try_element_at("own", i), F.lit(0)) + 0.5) / t))
    return by_entry.join(F.broadcast(by_level), "level").select("level", "entry", "n", rates.alias("rates"))


def _matrix(table: pa.Table, n: int) -> tuple[dict[str, int], np.ndarray]:
    """Place of each entry, and the rates by place and language."""
    column = table.column("rates").combine_chunks()
    return {e: i for i, e in enumerate(table.column("entry").to_pylist())}, column.flatten().to_numpy().reshape(-1, n)


def _added(vectors: Column, n: int) -> Column:
    """Sum of an array of vectors."""
    return F.aggregate(vectors, F.array_repeat(F.lit(0.0), n), lambda total, v: F.zip_with(total, v, lambda x, y: x + y))


def _backed_off(unknown: DataFrame, grams: DataFrame, n: int, gram_rates: int) -> DataFrame:
    """word and rates: the mean over the places of a word of the longest known n-gram there, each step back costing BACKOFF.

    Up to ``gram_rates`` rates the n-grams are broadcast, more are joined; the results are equal.
    """
    if grams.count() * n > gram_rates:
        pieces = F.expr(f"transform(sequence(1, length(word) + 1), i -> substring(concat(' ', word, ' '), i, {LONGEST}))")
        placed = unknown.select("word", F.explode(pieces).alias("piece"))
        tried = placed.select("piece").distinct().select("piece", F.explode(F.expr("transform(sequence(1, length(piece)), k -> substring(piece, 1, k))")).alias("entry"))
        longest = tried.join(grams, "entry").groupBy("piece").agg(F.max_by("rates", F.length("entry")).alias("rates"), F.max(F.length("entry")).alias("k"))
        of_piece = longest.select("piece", F.transform("rates", lambda x: x + (F.length("piece") - F.col("k")) * float(np.log(BACKOFF))).alias("rates"))
        hits = placed.join(of_piece, "piece").groupBy("word").agg(F.collect_list("rates").alias("hits"))
        mean = hits.select("word", F.transform(_added(F.col("hits"), n), lambda x: x / F.size("hits")).alias("rates"))
        return unknown.join(mean, "word", "left").select("word", F.coalesce("rates", F.array_repeat(F.lit(0.0), n)).alias("rates"))
    sent = unknown.sparkSession.sparkContext.broadcast(_matrix(grams.select("entry", "rates").toArrow(), n))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (places, rates), back = sent.value, float(np.log(BACKOFF))
        for batch in batches:
            own, word, weight = [], [], []
            for i, w in enumerate(batch.column(0).to_pylist()):
                padded = f" {w} "
                for at in range(len(padded) - 1):
                    most = min(LONGEST, len(padded) - at)
                    for k in range(most, 0, -1):
                        if (place := places.get(padded[at:at + k])) is not None:
                            own.append(place)
                            word.append(i)
                            weight.append((most - k) * back)
                            break
            found = rates[own] + np.array(weight)[:, None] if own else np.zeros((0, n))
            hits = np.maximum(1, np.bincount(np.array(word, np.int64), minlength=batch.num_rows))
            mean = np.stack([np.bincount(np.array(word, np.int64), found[:, k], batch.num_rows) / hits for k in range(n)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(mean)], names=["word", "rates"])

    return unknown.mapInArrow(lean(score), "word string, rates array<double>")


def _lists(matrix: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(np.ascontiguousarray(matrix, np.float64).ravel()))


def language_of(docs: DataFrame, labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", head_rates: int = HEAD_RATES, gram_rates: int = GRAM_RATES) -> DataFrame:
    """doc_id, lang_pred and score for every row of ``docs``, from a model trained on ``labelled`` (text, lang).

    ``und`` with score 0 where the text is null or has no letter, or no
    language was learned. Ties go to the first language by name. Null ids and
    equal rows stay; other columns are left out. ``head_rates`` and
    ``gram_rates`` bound what is broadcast, and not what counts.
    """
    text = clashing(docs, id_column, text_column).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = text.schema["doc_id"].dataType.simpleString()
    counts = written(_counts(labelled.filter("text IS NOT NULL AND lang IS NOT NULL")), "language-counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return text.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    n = len(langs)
    entries = written(_entries(counts, langs), "language-rates")
    words = entries.filter("level = 0")
    head = words.filter(F.col("n") >= cutoff(words, "n", max(1, head_rates // n)))
    sent = docs.sparkSession.sparkContext.broadcast(_matrix(head.select("entry", "rates").toArrow(), n))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the words of the head; other words with their counts."""
        places, rates = sent.value
        for batch in batches:
            for lo, texts in string_blocks(batch.column(1)):
                distinct, index, doc = words_of(texts)
                place = np.fromiter((places.get(w, -1) for w in distinct.to_pylist()), np.int64, len(distinct))[index]
                known = place >= 0
                sums = np.stack([np.bincount(doc[known], rates[place[known], k], len(texts)) for k in range(n)], axis=1)
                own, times = np.unique(doc[~known] * max(1, len(distinct)) + index[~known], return_counts=True)
                ends = np.append(0, np.cumsum(np.bincount(own // max(1, len(distinct)), minlength=len(texts)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)), batch.column(2).slice(lo, len(texts)), pa.array(np.bincount(doc, minlength=len(texts)) > 0), _lists(sums),
                     pa.ListArray.from_arrays(pa.array(ends), distinct.take(pa.array(own % max(1, len(distinct)))).cast(pa.string())),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int64)))], names=["doc_id", "row", "some", "sums", "words", "times"])

    begun = written(text.mapInArrow(lean(begin), f"doc_id {kind}, row long, some boolean, sums array<double>, words array<string>, times array<long>"), "language-begun")
    rest = begun.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    asked = rest.select("word").distinct()
    looked_up = written(asked.join(words.select(F.col("entry").alias("word"), "rates"), "word", "left"), "language-words")
    backed = _backed_off(looked_up.filter("rates IS NULL").select("word"), entries.filter("level > 0").select("entry", "rates"), n, gram_rates)
    scored = written(looked_up.filter("rates IS NOT NULL").unionByName(backed), "language-scored")
    weighed = rest.join(scored, "word").select("row", F.transform("rates", lambda x: x * F.col("times")).alias("rates"))
    more = weighed.groupBy("row").agg(_added(F.collect_list("rates"), n).alias("more"))
    summed = begun.select("doc_id", "row", "some", "sums").join(more, "row", "left").select(
        "doc_id", "some", F.zip_with("sums", F.coalesce("more", F.array_repeat(F.lit(0.0), n)), lambda x, y: x + y).alias("sums"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, "und"], object)
        for batch in batches:
            sums, some = batch.column(2).flatten().to_numpy().reshape(-1, n), batch.column(1).to_numpy(zero_copy_only=False)
            odds = np.exp(sums - sums.max(axis=1, keepdims=True))
            best, share = np.where(some, sums.argmax(axis=1), n), np.where(some, odds.max(axis=1) / odds.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    return summed.mapInArrow(lean(predict), f"doc_id {kind}, lang_pred string, score double")


def held_out_language(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``language_of`` all rows, learned from those whose crc32 of the id leaves no 2 modulo 4; ``held_out`` marks the others."""
    labelled = docs.filter(~in_fold(F.col(id_column), 4, 2)).select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    return language_of(docs, labelled, id_column, text_column).select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
