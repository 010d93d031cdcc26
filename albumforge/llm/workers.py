"""Memory of Python workers, which Spark keeps for later stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def release() -> None:
    """Give what Arrow and the C library hold but don't use back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that starts and leaves its worker without freed memory of other work."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from fn(batches)
        release()

    return run


def lean_group(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The same for a function of one group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf)
        release()
        return out

    return run


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that start here send workers at most ``rows`` rows at a time, so that neither side holds a large batch."""
    usual = spark.conf.get(_BATCH_ROWS)
    if not 0 < int(usual) <= rows:
        spark.conf.set(_BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, usual)
