"""Scores and vectors made elsewhere, keyed by photo id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumforge.functions.pixels import unit_vector
from albumforge.functions.scores import unit_clamp
from albumforge.functions.telemetry import json_type

MAX_REASON = 80


def attach_vectors(photos: DataFrame, vectors: DataFrame, keys=("library_id", "photo_id"),
                   normalise: bool = False) -> DataFrame:
    """Left join of vectors; photos without one get null."""
    v = vectors.select(*keys, (unit_vector(F.col("embedding")) if normalise else F.col("embedding")).alias("embedding"))
    return photos.join(v, list(keys), "left")


def attach_scores(photos: DataFrame, scores: DataFrame, candidates: DataFrame,
                  keys=("library_id", "photo_id")) -> DataFrame:
    """Score, keep and reason for candidates that were scored; null for everything else."""
    keys = list(keys)
    known = scores.join(candidates.select(*keys), keys, "left_semi").select(
        *keys, F.col("score").alias("aesthetic_score"), F.col("keep").alias("aesthetic_keep"),
        F.coalesce("reason", F.lit("")).alias("aesthetic_reason"))
    return photos.join(known, keys, "left")


def parse_reply(content):
    """A model's text reply to (score, keep, reason), or null when there is no usable score."""
    # What stands inside a fence, or the whole reply where there is none.
    bare = F.regexp_extract(content, r"(?is)^\s*(?:```(?:json)?)?(.*?)(?:```)?\s*$", 1)
    doc = F.try_parse_json(bare)

    def typed(key: str, cast: str, *types: str):
        field = F.try_variant_get(doc, f"$.{key}", "variant")
        return F.when(json_type(field).isin(*types), F.try_variant_get(doc, f"$.{key}", cast))

    score = unit_clamp(typed("score", "double", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"))
    is_number = typed("score", "double", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT").isNotNull()
    return F.when(is_number, F.struct(
        score.alias("score"), typed("keep", "boolean", "BOOLEAN").alias("keep"),
        F.coalesce(F.substring(typed("reason", "string", "STRING"), 1, MAX_REASON), F.lit("")).alias("reason")))
