"""The whole selection path: duplicates, clusters, lead photos, chapters, documents."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumforge.operators import chapters as ch
from albumforge.operators import documents as doc
from albumforge.operators.dedup import burst_members
from albumforge.plans.strategies import Kind, Step, step
from albumforge.session import cut_lineage


@dataclass
class Selection:
    """What the path leaves: tables, not yet written anywhere."""

    marked: DataFrame
    placed: DataFrame
    chapters: DataFrame
    bursts: DataFrame
    mapped: DataFrame
    meta: DataFrame


def select_photos(files: DataFrame, cluster_by: str = "day", cluster_options: Mapping | None = None,
                  highlight_dates: Sequence[str] = (), tz: str = "UTC",
                  stages: Mapping[str, Callable[..., DataFrame]] | None = None) -> Selection:
    """``files`` is the stored photo table with ``fingerprint`` and ``hash`` (and ``embedding`` for 'semantic').

    Fingerprints and hashes come from file contents; keep them in a table, since
    this path reads its input more than once.

    ``stages`` replaces any stage by a function with the same contract. Tables
    that several later steps read are cut to the checkpoint folder once, so no
    step is worked out again.
    """
    given = {Kind(name): run for name, run in (stages or {}).items()}

    def chosen(kind: Kind, name: str) -> Step:
        """The named step, its work replaced where the caller gave a function for it."""
        known = step(kind, name)
        return Step(given[kind], known.reads, known.adds, known.keeps, known.place) if kind in given else known

    marked = cut_lineage(files.transform(chosen(Kind.DEDUP, "default")))
    kept = marked.where(F.col("status") == "kept")
    clusters = chosen(Kind.CLUSTER, cluster_by)
    clustered = kept.transform(clusters, **dict(cluster_options or {}))
    placed = cut_lineage(ch.chapter_photos(clusters.place(clustered)))
    if Kind.SCORE in given:
        # A scorer of the caller's names its own result; it may add columns but drop none, and no photo.
        placed = cut_lineage(placed.transform(Step(given[Kind.SCORE])))
    heroes = placed.transform(chosen(Kind.HERO, "default"), highlight_dates=highlight_dates, tz=tz)
    keys = ["library_id", "cluster_idx"]
    chapters = cut_lineage(
        heroes.join(ch.median_coords(placed, keys), keys, "left")
        .withColumn("chapter_id", ch.chapter_id(F.col("cluster_idx"))))
    bursts = ch.live_bursts(burst_members(marked), placed)
    mapped = doc.photo_map(marked, placed, bursts)
    return Selection(marked, placed, chapters, bursts, mapped, doc.document_meta(files, kept, mapped, chapters))


def write_selection(selection: Selection, path: str) -> None:
    """Document parts of every library as JSON lines."""
    parts = doc.document_parts(selection.mapped, selection.chapters, selection.placed, selection.bursts, selection.meta)
    doc.write_documents(parts, path)
