"""Instants and local wall-clock time. The zone is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(ts: Column, tz: str) -> Column:
    """Wall-clock time (TIMESTAMP_NTZ) of an instant in zone ``tz``."""
    return F.convert_timezone(F.current_timezone(), F.lit(tz), ts.cast("timestamp_ntz"))


def local_date(ts: Column, tz: str) -> Column:
    return F.to_date(local_time(ts, tz))


def local_clock(ts: Column, tz: str) -> Column:
    """'HH:MM', empty when there is no time."""
    return F.coalesce(F.date_format(local_time(ts, tz), "HH:mm"), F.lit(""))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds, 0 when there is no time."""
    return F.coalesce(F.unix_millis(ts), F.lit(0).cast("bigint"))


def instant_of(ntz: Column) -> Column:
    """The instant a zone-less UTC reading stands for, whatever the session zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ntz).cast("timestamp")
