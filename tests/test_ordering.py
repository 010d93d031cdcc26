"""Positions, neighbours, running values and order statistics, on both paths."""

import random

import pytest
from pyspark.sql import functions as F

from albumforge.operators.ordering import neighbours, rank_values, running, with_positions


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    # A third of all rows sit in group 0, and many share a value.
    return [(0 if i % 3 == 0 else rnd.randrange(1, 9), rnd.randrange(40) if rnd.random() < 0.9 else None, i)
            for i in range(3000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g int, v int, id int")


def expected_order(rows):
    groups = {}
    for g, v, i in rows:
        groups.setdefault(g, []).append((v is None, v or 0, i))
    return {g: [i for *_, i in sorted(rs)] for g, rs in groups.items()}


@pytest.mark.parametrize("window_rows", [0, 10**9])
def test_positions(spark, rows, window_rows):
    out = with_positions(frame(spark, rows), ["g"], [F.col("v").asc_nulls_last(), F.col("id").asc()],
                         size="n", partitions=8, window_rows=window_rows).collect()
    want = expected_order(rows)
    assert len(out) == len(rows)
    for r in out:
        assert want[r["g"]][r["pos"]] == r["id"] and r["n"] == len(want[r["g"]])


def test_big_group_is_cut_over_tasks(spark, rows):
    from albumforge.operators.ordering import spread_sorted

    laid = spread_sorted(frame(spark, rows), ["g"], [F.col("v").asc_nulls_last(), F.col("id").asc()], partitions=8)
    assert laid.where("g = 0").select("_part").distinct().count() > 1


@pytest.mark.parametrize("offset,block", [(1, 7), (1, 1000), (3, 4), (5, 2)])
def test_neighbours_across_blocks(spark, rows, offset, block):
    placed = with_positions(frame(spark, rows), ["g"], [F.col("id").asc()])
    out = neighbours(placed, ["g"], before={"b": "id"}, after={"a": "id"}, offset=offset, block=block).collect()
    by = {}
    for g, _, i in rows:
        by.setdefault(g, []).append(i)
    assert len(out) == len(rows)
    for r in out:
        ids, p = by[r["g"]], r["pos"]
        assert r["b"] == (ids[p - offset] if p >= offset else None)
        assert r["a"] == (ids[p + offset] if p + offset < len(ids) else None)


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running_across_blocks(spark, rows, how):
    placed = with_positions(frame(spark, rows), ["g"], [F.col("id").asc()])
    out = {(r["g"], r["pos"]): r["r"] for r in running(placed, ["g"], "v", "r", how, block=11).collect()}
    state = {}
    counts = {}
    for g, v, _ in rows:
        p = counts.get(g, 0)
        counts[g] = p + 1
        if how == "sum":
            state[g] = state.get(g, 0) + (v or 0)
        elif v is not None:
            state[g] = max(state.get(g, v), v)
        assert out[(g, p)] == state.get(g)


@pytest.mark.parametrize("width", [0.25, 6, 1e9])
def test_rank_values(spark, rows, width):
    got = rank_values(frame(spark, rows), ["g"], "v", {"lo": F.lit(0), "mid": F.floor(F.col("n") / 2), "hi": F.col("n") - 1}, width, parts=4).collect()
    by = {}
    for g, v, _ in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    assert len(got) == len(by)
    for r in got:
        vs = sorted(by[r["g"]])
        assert (r["lo"], r["mid"], r["hi"]) == (vs[0], vs[len(vs) // 2], vs[-1])


def test_rank_values_of_one_place_and_of_close_ones(spark):
    same = spark.range(2_000_000).select(F.lit("same").alias("g"), F.lit(-12.3456789).alias("v"))
    close = spark.range(50_000).select(F.lit("close").alias("g"), (F.col("id") * 1e-9 - 5).alias("v"))
    started = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    plan = rank_values(same.union(close), ["g"], "v", {"mid": F.floor(F.col("n") / 2)}, 0.001)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == started  # nothing ran yet
    got = {r["g"]: r["mid"] for r in plan.collect()}
    assert got == {"same": -12.3456789, "close": 25_000 * 1e-9 - 5}
