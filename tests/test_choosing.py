"""Quotas against the unit-by-unit loop, starter sets, histograms, semantic clusters."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from albumforge.operators import quota, selection, semantic


def allocate(sizes, total, target):
    cap = min(target, total) if target > 0 else 0
    exact = [n / total * cap for n in sizes]
    alloc = [min(n, math.floor(e)) for n, e in zip(sizes, exact)]
    left = cap - sum(alloc)
    order = sorted(range(len(sizes)), key=lambda i: -(exact[i] - math.floor(exact[i])))
    while left > 0:
        moved = False
        for i in order:
            if left <= 0:
                break
            if alloc[i] < sizes[i]:
                alloc[i] += 1
                left -= 1
                moved = True
        if not moved:
            break
    return alloc


def run_quota(spark, cases):
    chapters = [(c, i, n) for c, (sizes, _, _) in enumerate(cases) for i, n in enumerate(sizes)]
    targets = [(c, total, target) for c, (_, total, target) in enumerate(cases)]
    got = quota.allocate_targets(
        spark.createDataFrame(chapters, "library_id int, cluster_idx int, photo_count long"),
        spark.createDataFrame(targets, "library_id int, total_photos long, target_count long")).collect()
    out = {}
    for r in got:
        out.setdefault(r["library_id"], {})[r["cluster_idx"]] = r["target"]
    return [[out[c][i] for i in range(len(sizes))] for c, (sizes, _, _) in enumerate(cases)]


def test_quota_equals_loop(spark):
    rnd = random.Random(11)
    cases = []
    for _ in range(300):
        sizes = [rnd.randrange(1, 40) for _ in range(rnd.randrange(1, 12))]
        total = sum(sizes) + rnd.choice((0, 0, 3, 25, 200))
        cases.append((sizes, total, rnd.choice((0, 1, 7, 30, total, total + 50, rnd.randrange(1, total + 1)))))
    assert run_quota(spark, cases) == [allocate(*c) for c in cases]


def test_quota_sum_cap_and_zero(spark):
    got = run_quota(spark, [([10, 10, 10], 30, 10), ([2, 50], 52, 40), ([5, 5], 10, 0), ([3, 3], 6, 100), ([4, 4, 4], 12, 2)])
    assert [sum(g) for g in got] == [10, 40, 0, 6, 2]
    assert got[1][0] <= 2


def test_starters_hero_first_then_quality(spark):
    photos = spark.createDataFrame(
        [("L", 0, i, f"p{i}", q) for i, q in enumerate((0.1, 0.9, None, 0.5, 0.0))],
        "library_id string, cluster_idx int, pos long, photo_id string, quality double")
    heads = spark.createDataFrame([("L", 0, "p2", 4)], "library_id string, cluster_idx int, hero_photo_id string, target long")
    got = [r["photo_id"] for r in quota.starter_set(photos, heads).orderBy("pick").collect()]
    assert got == ["p2", "p1", "p3", "p0"]
    none = heads.withColumn("target", F.lit(0).cast("long"))
    assert quota.starter_set(photos, none).count() == 0


def test_missing_quality_ranks_below_zero(spark):
    photos = spark.createDataFrame([("L", 0, 0, "n", None), ("L", 0, 1, "z", 0.0)],
                                   "library_id string, cluster_idx int, pos long, photo_id string, quality double")
    heads = spark.createDataFrame([("L", 0, None, 1)], "library_id string, cluster_idx int, hero_photo_id string, target long")
    assert [r["photo_id"] for r in quota.starter_set(photos, heads).collect()] == ["z"]


def test_histogram_cells_and_edges(spark):
    q = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 1.0, "e": None, "f": 0.74}
    universe = spark.createDataFrame([("L", k, v) for k, v in q.items()], "library_id string, photo_id string, quality double")
    ids = lambda *xs: spark.createDataFrame([("L", x) for x in xs], "library_id string, photo_id string")
    row = selection.quality_histogram(selection.mark_choices(universe, ids("a", "b", "e"), ids("a", "d", "e"))).first()
    assert row["tp_q0"] == 1 and row["fp_q1"] == 1 and row["fn_q3"] == 1 and row["tn_q2"] == 2 and row["null_quality"] == 1
    assert sum(row[f"{c}_q{i}"] for c in selection.CELLS for i in range(4)) + row["null_quality"] == len(q)


def brute_kmeans(vectors, start, rounds=50):
    cents, before = [np.array(c) for c in start], [0] * len(vectors)
    for _ in range(rounds):
        now = [int(np.argmax([v @ c for c in cents])) for v in vectors]
        if now == before:
            break
        before = now
        for c in range(len(cents)):
            members = [v for v, a in zip(vectors, now) if a == c]
            if members:
                m = np.mean(members, axis=0)
                cents[c] = m / (np.linalg.norm(m) or 1)
    return before


def test_kmeans_equals_loop(spark):
    rng = np.random.default_rng(5)
    rows, want, starts = [], {}, []
    for lib in range(3):
        v = rng.normal(size=(60, 6))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        starts.append((lib, [list(map(float, x)) for x in v[:4]]))
        for i, a in enumerate(brute_kmeans(list(v), v[:4])):
            want[(lib, i)] = a
        rows += [(lib, f"p{i}", i, list(map(float, x))) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "library_id int, photo_id string, ordinal int, embedding array<double>")
    initial = spark.createDataFrame(starts, "library_id int, centroids array<array<double>>")
    got = {(r["library_id"], r["ordinal"]): r["cluster"] for r in semantic.kmeans(df, k=4, initial=initial).collect()}
    assert got == want


def test_kmeans_seeding_finds_separate_groups(spark):
    axes = np.eye(3)
    rows = []
    for i in range(30):
        v = axes[i % 3] + 0.01 * ((i * 7) % 5)
        v /= np.linalg.norm(v)
        rows.append((0, f"p{i}", i, list(map(float, v))))
    df = spark.createDataFrame(rows, "library_id int, photo_id string, ordinal int, embedding array<double>")
    got = {r["ordinal"]: r["cluster"] for r in semantic.kmeans(df, k=3).collect()}
    assert len(set(got.values())) == 3
    assert all(got[i] == got[i % 3] for i in range(30))


def test_semantic_fallbacks(spark):
    rows = [(0, "a", 0, None, None), (0, "b", 1, None, None), (1, "c", 0, [1.0, 0.0], None), (1, "d", 1, [0.0, 1.0], None), (1, "e", 2, None, None)]
    df = spark.createDataFrame(rows, "library_id int, photo_id string, ordinal int, embedding array<double>, ts timestamp")
    got = {r["photo_id"]: r["cluster_idx"] for r in semantic.semantic_clusters(df).collect()}
    assert got["a"] == got["b"] == 0
    assert got["c"] != got["d"] and got["e"] == 2


@pytest.mark.parametrize("n,k", [(1, 2), (16, 2), (20, 3), (28, 4), (1000, 12)])
def test_default_k(spark, n, k):
    assert spark.range(1).select(semantic.default_k(F.lit(n)).alias("k")).first()["k"] == k
