"""Documents to packed sequences: STAGES names the steps; run() writes each as Parquet and reads it again for the next.

Each stage works on all rows that its predecessor kept and returns the columns
of documents, but for the last, which returns the packed pieces. Decisions are
made per row: where a stage has to come back to a row it does so by a key of
the row's own, so null and repeated ids share nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.llm.common import fresh, keyed, sized, table, written
from albumforge.llm.mixing import mix
from albumforge.llm.ngram_join import ngram_jaccard_join
from albumforge.llm.packing import best_fit_packing
from albumforge.llm.quality_rules import quality_rules
from albumforge.llm.quality_votes import good_rows


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' votes find good."""
    return good_rows(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    key = fresh(docs, "row_key")
    rows = keyed(docs, key)
    kept = quality_rules(rows, key).filter("kept").select(F.col("doc_id").alias(key))
    return rows.join(sized(written(kept, "kept")), key, "left_semi").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, null ids last. Rows without links all stay, whatever their ids."""
    key = fresh(docs, "row_key")
    rows = keyed(docs, key)
    joined = written(ngram_jaccard_join(rows, key).select(F.col("doc_id").alias(key), "component_id"), "components")
    by_id = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("key"))
    first = joined.join(rows.select(key, "doc_id"), key).groupBy("component_id").agg(F.min(by_id).alias("first"))
    return rows.join(sized(written(first.select(F.col("first.key").alias(key)), "leaders")), key, "left_semi").select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    key, times = fresh(docs, "row_key"), fresh(docs, "copies")
    rows = keyed(docs, key)
    taken = written(mix(rows, key_column=key).filter("copies > 0").select(F.col("row_key").alias(key), F.col("copies").alias(times)), "copies")
    return rows.join(sized(taken), key).withColumn(times, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of 4096 tokens."""
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"), end=1)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", mixed_sources),
    ("best-fit packing", packing),
]
#: Trained models, EM and tokenizers can't be said in SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
