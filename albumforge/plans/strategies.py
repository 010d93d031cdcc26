"""Ways to do each step of the selection path, each with a contract that is checked.

A step names the columns it reads and the columns it adds. Both are checked
when the step is applied, on schemas alone, so a step that drops what later
ones need fails where it is put in and not in the middle of a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumforge.operators.chapters import select_heroes
from albumforge.operators.cluster import day_clusters, gap_clusters, place_in_clusters
from albumforge.operators.dedup import dedup
from albumforge.operators.selection import scoring_candidates
from albumforge.operators.semantic import place_semantic, semantic_clusters


class Kind(Enum):
    """What a step is for, under the name that settings use."""

    DEDUP = "dedup"
    CLUSTER = "cluster"
    SCORE = "aestheticScore"
    HERO = "heroSelect"


class BrokenContract(ValueError):
    """A step was given, or gave back, a table without the columns it promised."""


@dataclass(frozen=True)
class Step:
    """``run`` takes a table and options. ``keeps``: the result still has every column it was given."""

    run: Callable[..., DataFrame]
    reads: frozenset[str] = frozenset()
    adds: frozenset[str] = frozenset()
    keeps: bool = True
    #: For clusters: how photos are placed inside one.
    place: Callable[[DataFrame], DataFrame] | None = None

    def __call__(self, df: DataFrame, **options) -> DataFrame:
        if lacking := self.reads - set(df.columns):
            raise BrokenContract(f"step reads columns that are not there: {sorted(lacking)}")
        out = self.run(df, **options)
        due = self.adds | (set(df.columns) if self.keeps else set())
        if lost := due - set(out.columns):
            raise BrokenContract(f"step should leave columns that are gone: {sorted(lost)}")
        return out


def flag_candidates(placed: DataFrame, **options) -> DataFrame:
    """Every photo, with ``is_candidate`` for those worth a model's time; no photo is dropped."""
    keys = ["library_id", "photo_id"]
    chosen = scoring_candidates(placed, **options).select(*keys, F.lit(True).alias("is_candidate"))
    return placed.join(chosen, keys, "left").withColumn("is_candidate", F.coalesce("is_candidate", F.lit(False)))


def _columns(*names: str) -> frozenset[str]:
    return frozenset(names)


_PHOTO = _columns("library_id", "photo_id", "ordinal")
_BUILT_IN: dict[tuple[Kind, str], Step] = {
    (Kind.DEDUP, "default"): Step(dedup, _PHOTO | {"fingerprint", "hash", "name"}, _columns("status")),
    (Kind.CLUSTER, "day"): Step(day_clusters, _PHOTO | {"ts"}, _columns("cluster_idx"), place=place_in_clusters),
    (Kind.CLUSTER, "timeGap"): Step(gap_clusters, _PHOTO | {"ts"}, _columns("cluster_idx"), place=place_in_clusters),
    (Kind.CLUSTER, "semantic"): Step(semantic_clusters, _PHOTO | {"ts", "embedding"}, _columns("cluster_idx"), place=place_semantic),
    (Kind.SCORE, "default"): Step(flag_candidates, _columns("library_id", "photo_id", "cluster_idx", "pos"), _columns("is_candidate")),
    (Kind.HERO, "default"): Step(select_heroes, _columns("library_id", "photo_id", "cluster_idx", "pos"), _columns("hero_photo_id"), keeps=False),
}
_OWN: dict[tuple[Kind, str], Step] = {}


def offered(kind: Kind | str) -> list[str]:
    return sorted({name for k, name in (*_BUILT_IN, *_OWN) if k is Kind(kind)})


def step(kind: Kind | str, name: str) -> Step:
    """The step of that kind and name; one offered later hides a built-in of the same name."""
    at = (Kind(kind), name)
    if at in _OWN:
        return _OWN[at]
    if at in _BUILT_IN:
        return _BUILT_IN[at]
    raise LookupError(f"no {at[0].value} step is called {name!r}; there are {offered(kind)}")


def offer(kind: Kind | str, name: str, run: Callable[..., DataFrame], reads: Iterable[str] = (), adds: Iterable[str] = (), keeps: bool = True,
          place: Callable[[DataFrame], DataFrame] | None = None) -> Step:
    """Make a step of one's own known. A way to cluster is placed by time and name unless ``place`` is given."""
    if Kind(kind) is Kind.CLUSTER and place is None:
        place = place_in_clusters
    made = Step(run, frozenset(reads), frozenset(adds), keeps, place)
    _OWN[Kind(kind), name] = made
    return made
