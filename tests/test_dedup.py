"""Fingerprints and the greedy near-duplicate walk against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from albumforge.functions import pixels as px
from albumforge.operators import dedup as dd


def loop(photos, threshold=10, window=5):
    kept, out = [], {}
    for pid, h in photos:
        if h is None:
            kept.append((None, pid))
            out[pid] = ("kept", None, None, None)
            continue
        best = None
        for k, kid in kept[-window:][::-1]:
            if k is not None:
                d = bin((k ^ h) & dd.MASK).count("1")
                if best is None or d < best[0]:
                    best = (d, kid)
        if best and best[0] <= threshold:
            out[pid] = ("burst", best[1], best[0], None)
        else:
            kept.append((h, pid))
            out[pid] = ("kept", None, None, best[0] if best else None)
    return out


def signed(v):
    return v - 2**64 if v >= 2**63 else v


def library(rnd, n, chain):
    """Drifting hashes: with ``chain`` every picture is close to the one before, so ends depend on starts."""
    h, out = rnd.getrandbits(64), []
    for _ in range(n):
        if rnd.random() < (0.95 if chain else 0.4):
            for _ in range(rnd.randrange(5 if chain else 9)):
                h ^= 1 << rnd.randrange(64)
        else:
            h = rnd.getrandbits(64)
        out.append(None if rnd.random() < 0.05 else signed(h))
    return out


@pytest.mark.parametrize("chain,partitions", [(False, 8), (True, 8), (True, 40), (False, 1)])
def test_walk_equals_loop(spark, chain, partitions):
    rnd = random.Random(7)
    rows, want = [], {}
    for lib, n in enumerate((900, 3, 0, 400, 1, 60)):
        hashes = library(rnd, n, chain)
        names = list(range(n))
        for i, h in enumerate(hashes):
            rows.append((lib, f"{lib}:{i}", f"IMG_{names[i]}.jpg", i, h))
        want.update(loop([(f"{lib}:{i}", h) for i, h in enumerate(hashes)]))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "library_id int, photo_id string, name string, ordinal int, hash long")
    got = {r["photo_id"]: (r["status"], r["rep_id"], r["distance"], r["nearest_distance"])
           for r in dd.near_duplicates(df, partitions=partitions).collect()}
    assert got == want


def test_walk_when_every_end_depends_on_its_start(spark):
    # One picture repeated: all are copies of the very first, through every task.
    rows = [(0, f"p{i}", f"IMG_{i}.jpg", i, 5) for i in range(200)]
    df = spark.createDataFrame(rows, "library_id int, photo_id string, name string, ordinal int, hash long")
    got = dd.near_duplicates(df, partitions=12).collect()
    assert sum(r["status"] == "kept" for r in got) == 1
    assert {r["rep_id"] for r in got if r["status"] == "burst"} == {"p0"}


def test_hamming(spark):
    df = spark.createDataFrame([(0, 0), (0, -1), (1, 2), (-1, -2)], "a long, b long")
    assert [r[0] for r in df.select(px.hamming(F.col("a"), F.col("b"))).collect()] == [0, 64, 2, 1]


def test_fingerprint_is_of_the_whole_content(spark):
    base = b"a" * 100
    rows = [("x", base + b"1" * 50 + base), ("y", base + b"2" * 50 + base), ("z", base + b"1" * 51 + base), ("s", b"abc"), ("t", b"abd"), ("u", base + b"1" * 50 + base)]
    df = spark.createDataFrame(rows, "id string, c binary")
    fp = {r["id"]: r["f"] for r in df.select("id", dd.fingerprint(F.col("c")).alias("f")).collect()}
    assert fp["x"] == fp["u"] and len(set(fp.values())) == 5


def test_first_copy_in_input_order_is_kept(spark):
    df = spark.createDataFrame([("L", 3, "c", "f"), ("L", 1, "a", "f"), ("L", 2, "b", "f"), ("M", 9, "z", "f")],
                               "library_id string, ordinal int, photo_id string, fingerprint string")
    got = {r["photo_id"]: (r["status"], r["first_ordinal"]) for r in dd.exact_duplicates(df).collect()}
    assert got == {"a": ("kept", None), "b": ("exact", 1), "c": ("exact", 1), "z": ("kept", None)}


def test_block_hash_twins_agree(spark):
    rnd = random.Random(3)
    rows = [([float(rnd.randrange(256)) for _ in range(1024)],) for _ in range(20)] + [([7.0] * 1024,)]
    df = spark.createDataFrame(rows, "g array<double>")
    for r in df.select(px.block_hash(px.block_means(F.col("g"))).alias("a"), px.block_hash_np(F.col("g")).alias("b")).collect():
        assert r["a"] == r["b"]


def test_laplacian_twins_agree(spark):
    rnd = random.Random(4)
    rows = [([float(rnd.randrange(256)) for _ in range(w * h)], w, h) for w, h in ((8, 8), (5, 9), (3, 3), (2, 6), (1, 1))]
    df = spark.createDataFrame(rows, "g array<double>, w int, h int")
    cols = [f(F.col("g"), F.col("w"), F.col("h")) for f in (px.laplacian_variance, px.laplacian_variance_np)]
    for a, b in df.select(*cols).collect():
        assert a == pytest.approx(b, rel=1e-9) and a >= 0


def test_equal_pictures_take_two_rounds(spark):
    """Pieces that pass on what they were handed are not walked again and again."""
    rows = [("L", f"p{i:04}", i, f"n{i:04}", 5) for i in range(2000)]
    df = spark.createDataFrame(rows, "library_id string, photo_id string, ordinal long, name string, hash long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("walk", "near duplicates")
    try:
        found = dd.near_duplicates(df, partitions=20)
        jobs = len(tracker.getJobIdsForGroup("walk"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {(r["status"], r["rep_id"]): r["count"] for r in found.groupBy("status", "rep_id").count().collect()}
    assert got == {("kept", None): 1, ("burst", "p0000"): 1999}
    assert jobs <= 6
