"""What a finished curation reports: four event rows per session, from presses, starters and kept photos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumforge.operators import metrics as m
from albumforge.operators.curation import session_counts
from albumforge.operators.selection import quality_histogram


def library_facts(marked: DataFrame, uploaded: DataFrame, library_id: str = "library_id") -> DataFrame:
    """One row per library: what was uploaded, chosen by the rules and kept, and the quality histogram.

    ``marked``: photos with ``is_auto``, ``is_kept`` and ``quality``. ``uploaded``: library and ``uploaded``.
    """
    kept = marked.groupBy(library_id).agg(F.count_if("is_auto").alias("auto_kept"), F.count_if("is_kept").alias("user_kept"))
    return kept.join(quality_histogram(marked, library_id), library_id).join(uploaded.select(library_id, "uploaded"), library_id, "full_outer")


def reports(first: DataFrame, facts: DataFrame, library_id: str = "library_id") -> DataFrame:
    """The events of finishes (library, ``session_id``, ``finished_at``, ``started_at``, ``presses``, ``distinct_photos``)."""
    # One row per library on the right, for a stream of finishes too.
    told = first.join(facts, library_id, "left")
    counts = [c for c in facts.columns if c not in (library_id, "null_quality", "auto_kept", "user_kept", "uploaded")]
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    ms = F.round((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000).cast("bigint")
    bodies = (
        (m.CURATION_DURATION, F.when(F.col("started_at").isNotNull(), F.to_json(F.struct(ms.alias("ms"))))),
        (m.TOGGLE_COUNT, F.to_json(F.struct(number("presses").alias("presses"), number("distinct_photos").alias("distinctPhotos")))),
        (m.CURATION_FUNNEL, F.to_json(F.struct(number("uploaded").alias("uploaded"), number("auto_kept").alias("autoKept"), number("user_kept").alias("userKept")))),
        (m.QUALITY_ERRORS, F.to_json(F.struct(*[number(c).alias(c) for c in counts], number("null_quality").alias("nullQuality")))),
    )
    rows = F.array(*[F.struct(F.lit(name).alias("event_name"), body.alias("properties")) for name, body in bodies])
    return told.select(library_id, "session_id", F.col("finished_at").alias("server_ts"), F.inline(rows)).where("properties IS NOT NULL")


def completion_events(finishes: DataFrame, actions: DataFrame, marked: DataFrame, uploaded: DataFrame,
                      library_id: str = "library_id") -> DataFrame:
    """(library, session_id, server_ts, event_name, properties) for the first finish of each session.

    ``finishes``: library, ``session_id``, ``finished_at`` and ``started_at`` (null when unknown: no duration then).
    ``actions``: presses (``photo_id``, ``seq``, ``action``). ``marked`` and ``uploaded``: see ``library_facts``.
    Later finishes of a session report nothing.
    """
    first = finishes.groupBy(library_id, "session_id").agg(
        F.min_by(F.struct("finished_at", "started_at"), "finished_at").alias("_f")).select(library_id, "session_id", "_f.*")
    presses = session_counts(actions, library_id).select(library_id, "presses", "distinct_photos")
    return reports(first.join(presses, library_id, "left"), library_facts(marked, uploaded, library_id), library_id)
