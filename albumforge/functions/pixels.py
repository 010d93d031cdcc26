"""Pixel grids and fingerprints as native expressions, with vectorised twins for big grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row, even where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gray_levels(red: Column, green: Column, blue: Column) -> Column:
    """Three channel arrays to rounded gray levels."""
    rg = F.zip_with(red, green, lambda r, g: 0.299 * r + 0.587 * g)
    return F.zip_with(rg, blue, lambda x, b: F.floor(x + 0.114 * b + 0.5).cast("int"))


def block_means(gray: Column, side: int = 32, blocks: int = 8) -> Column:
    """Means of a ``blocks`` x ``blocks`` grid laid over a ``side`` x ``side`` picture, row by row."""
    step = side // blocks

    def mean_of(block: Column) -> Column:
        top = F.floor(block / blocks) * step
        left = block % blocks * step
        cells = F.transform(
            F.sequence(F.lit(0), F.lit(step * step - 1)),
            lambda c: F.get(gray, ((top + F.floor(c / step)) * side + left + c % step).cast("int")).cast("double"),
        )
        return F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + x) / (step * step)

    return F.transform(F.sequence(F.lit(0), F.lit(blocks * blocks - 1)), mean_of)


def block_hash(means: Column) -> Column:
    """64 block means to a BIGINT: bit i is set when mean i is above the middle of the 64."""
    values = F.transform(means, lambda x: x.cast("double"))
    none = F.lit(0).cast("bigint")

    def bits(middle: Column) -> Column:
        on = F.transform(values, lambda x, i: F.when(
            x > middle, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(none))
        return F.aggregate(on, none, lambda acc, b: acc.bitwiseOR(b))

    middle = bind(F.sort_array(values), lambda s: (F.get(s, F.lit(31)) + F.get(s, F.lit(32))) / 2)
    return bind(middle, bits)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def laplacian_variance(gray: Column, width: Column, height: Column) -> Column:
    """Population variance of the 4-neighbour Laplacian over inner cells; 0 without any."""
    inner_w, inner_h = width - 2, height - 2
    count = F.when((inner_w > 0) & (inner_h > 0), inner_w * inner_h).otherwise(F.lit(0))
    at = lambda i: F.get(gray, i.cast("int")).cast("double")

    def response(c: Column) -> Column:
        i = (F.floor(c / inner_w) + 1) * width + c % inner_w + 1
        return at(i - width) + at(i + width) + at(i - 1) + at(i + 1) - 4 * at(i)

    laps = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), response)
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    value = F.aggregate(
        laps, zero,
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q")),
        lambda acc: F.greatest(F.lit(0.0), acc["q"] / count - F.pow(acc["s"] / count, 2)),
    )
    return F.when(count > 0, value).when(count == 0, F.lit(0.0))


def _stacked(grids: pd.Series, rows: np.ndarray) -> np.ndarray:
    """Grids of one size as a matrix, a row each."""
    return np.stack(grids.iloc[rows].to_numpy()).astype(np.float64)


@F.pandas_udf(T.DoubleType())
def laplacian_variance_np(gray: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """The same for whole batches: one array operation for all grids of a size."""
    out = np.full(len(gray), np.nan)
    known = pd.DataFrame({"w": width, "h": height})[gray.notna().to_numpy()].reset_index(names="at")
    at = {label: k for k, label in enumerate(gray.index)}
    for (w, h), own in known.groupby(["w", "h"]):
        rows = np.array([at[x] for x in own["at"]])
        if w < 3 or h < 3:
            out[rows] = 0.0
            continue
        g = _stacked(gray, rows).reshape(len(rows), int(h), int(w))
        lap = g[:, :-2, 1:-1] + g[:, 2:, 1:-1] + g[:, 1:-1, :-2] + g[:, 1:-1, 2:] - 4 * g[:, 1:-1, 1:-1]
        out[rows] = np.maximum(0.0, (lap * lap).mean(axis=(1, 2)) - lap.mean(axis=(1, 2)) ** 2)
    return pd.Series(out).where(gray.notna().to_numpy(), None).astype("Float64")


@F.pandas_udf(T.LongType())
def block_hash_np(gray: pd.Series) -> pd.Series:
    """32 x 32 gray grids straight to their 64-bit hashes, a batch at a time."""
    known = np.flatnonzero(gray.notna().to_numpy())
    out = pd.Series([None] * len(gray), dtype="Int64")
    if len(known):
        means = _stacked(gray, known).reshape(len(known), 8, 4, 8, 4).mean(axis=(2, 4)).reshape(len(known), 64)
        ordered = np.sort(means, axis=1)
        on = means > ((ordered[:, 31] + ordered[:, 32]) / 2)[:, None]
        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
        out.iloc[known] = np.where(on, weights, np.uint64(0)).sum(axis=1, dtype=np.uint64).view(np.int64)
    return out


def fold_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return fold_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def unit_vector(v: Column) -> Column:
    """L2-normalised; the zero vector stays as it is."""
    norm = F.sqrt(fold_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return bind(F.when(norm == 0, F.lit(1.0)).otherwise(norm),
                lambda n: F.transform(v, lambda x: x.cast("double") / n))
