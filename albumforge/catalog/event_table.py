"""The metric views over the settled event table: days as partitions, clustered by name and time, VARIANT properties."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from albumforge.catalog.registry import ORACLES, query
from albumforge.catalog.streams import EVENTS
from albumforge.catalog.usage_metrics import as_text_day, metric_events
from albumforge.operators import metrics as m
from albumforge.session import shared_dir
from albumforge.sources import telemetry


def settled(spark: SparkSession, sf: str) -> str:
    """The events of all views, settled in one table; its folder."""
    path = f"{shared_dir(spark)}/albumforge-settled-{uuid.uuid4().hex}"
    rows = [metric_events(spark, sf, stored, name, **props()) for stored, name, props in EVENTS.values()]
    telemetry.settle_events(reduce(DataFrame.unionByName, rows), path)
    return path


def register(view: str, event_name: str) -> None:
    @query(f"table_{view}", ORACLES[view])
    def run(spark: SparkSession, sf: str) -> DataFrame:
        events = telemetry.settled_events(spark, settled(spark, sf), event_name)
        return as_text_day(getattr(m, view)(events) if hasattr(m, view) else m.timing_by_day(events, event_name))


for _view, (_stored, _name, _props) in EVENTS.items():
    register(_view, _name)
