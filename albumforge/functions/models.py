"""Calling a model over rows in small batches. The model itself is the caller's."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_SIZE = 16


def _guarded(make_predict: Callable, empty: Callable[[int], np.ndarray]) -> Callable:
    """Predict function whose failed batches give NaN instead of failing the task."""
    def make():
        predict = make_predict()

        def safe(*inputs: np.ndarray) -> np.ndarray:
            try:
                return np.asarray(predict(*inputs), dtype=np.float64)
            except Exception:
                return empty(len(inputs[0]))

        return safe

    return make


def model_scores(make_predict: Callable, *inputs: Column, batch_size: int = BATCH_SIZE) -> Column:
    """One number per row; null where the model failed.

    ``make_predict`` is called once per Python worker and returns a function
    from input arrays to an array of numbers.
    """
    udf = predict_batch_udf(_guarded(make_predict, lambda n: np.full(n, np.nan)),
                            return_type=T.DoubleType(), batch_size=batch_size)
    raw = udf(*inputs)
    return F.nullif(raw, F.lit(float("nan")))


def model_vectors(make_predict: Callable, dim: int, *inputs: Column, batch_size: int = BATCH_SIZE,
                  input_shapes: list | None = None) -> Column:
    """One vector of length ``dim`` per row; null where the model failed."""
    udf = predict_batch_udf(_guarded(make_predict, lambda n: np.full((n, dim), np.nan)),
                            return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                            input_tensor_shapes=input_shapes)
    raw = udf(*inputs)
    return F.when(~F.isnan(F.get(raw, F.lit(0))), raw)


def score_candidates(placed: DataFrame, candidates: DataFrame, make_predict: Callable, inputs: list[str],
                     available: Callable[[], bool] = lambda: True, keys=("library_id", "photo_id")) -> DataFrame:
    """Add ``aesthetic_score`` for candidates only.

    Only the cut candidate rows reach the model. When the model is not available
    every score is null and no Python worker is started.
    """
    keys = list(keys)
    if not available():
        return placed.withColumn("aesthetic_score", F.lit(None).cast("double"))
    scored = candidates.select(*keys, model_scores(make_predict, *[F.col(c) for c in inputs]).alias("aesthetic_score"))
    return placed.join(scored, keys, "left")
