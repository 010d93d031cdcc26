"""Day and gap clusters, positions, lead photos, chapters: the small cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from albumforge.operators import chapters as ch
from albumforge.operators import cluster as cl

SCHEMA = "library_id string, ordinal int, photo_id string, name string, ts timestamp, lat double, lng double, quality double, aesthetic_score double"


def photos(spark, rows):
    full = []
    for i, r in enumerate(rows):
        r = dict(r)
        full.append(("L", i, r.get("id", f"p{i}"), r.get("name", f"IMG_{i}.jpg"), r.get("ts"), r.get("lat"), r.get("lng"),
                     r.get("quality"), r.get("aesthetic")))
    return spark.createDataFrame(full, SCHEMA)


def at(h, m=0, s=0, day=1):
    return datetime(2025, 5, day, h, m, s)


def clusters(df):
    out = {}
    for r in cl.place_in_clusters(df).orderBy("cluster_idx", "pos").collect():
        out.setdefault(r["cluster_idx"], []).append(r["photo_id"])
    return [out[i] for i in sorted(out)]


def test_gap_of_exactly_the_limit_does_not_split(spark):
    df = photos(spark, [{"ts": at(10)}, {"ts": at(10, 45)}, {"ts": at(11, 30, 1)}])
    assert clusters(cl.gap_clusters(df)) == [["p0", "p1"], ["p2"]]


def test_gap_is_measured_to_the_photo_before_not_the_first(spark):
    df = photos(spark, [{"ts": at(10) + timedelta(minutes=40 * i)} for i in range(8)])
    assert clusters(cl.gap_clusters(df)) == [[f"p{i}" for i in range(8)]]


def test_unsorted_input_and_undated_last(spark):
    df = photos(spark, [{"ts": at(15)}, {}, {"ts": at(9)}, {"ts": at(9, 10)}, {"name": "IMG_0.jpg"}])
    assert clusters(cl.gap_clusters(df)) == [["p2", "p3"], ["p0"], ["p4", "p1"]]


def test_only_undated(spark):
    assert clusters(cl.gap_clusters(photos(spark, [{}, {}]))) == [["p0", "p1"]]
    assert clusters(cl.day_clusters(photos(spark, [{}, {}]))) == [["p0", "p1"]]


def test_zero_gap_means_default(spark):
    df = photos(spark, [{"ts": at(10)}, {"ts": at(10, 30)}])
    assert len(clusters(cl.cluster(df, "timeGap", 0))) == 1
    assert len(clusters(cl.cluster(df, "timeGap", 20))) == 2


def test_days_follow_the_zone(spark):
    df = photos(spark, [{"ts": at(23, 30)}, {"ts": at(0, 30, day=2)}])
    assert len(clusters(cl.day_clusters(df, "UTC"))) == 2
    assert len(clusters(cl.day_clusters(df, "Asia/Tokyo"))) == 1


def test_names_break_ties_as_numbers(spark):
    t = at(10)
    df = photos(spark, [{"ts": t, "name": "IMG_10.jpg"}, {"ts": t, "name": "img_2.jpg"}, {"ts": t, "name": "IMG_1.jpg"}])
    assert clusters(cl.day_clusters(df)) == [["p2", "p1", "p0"]]


def hero(spark, rows, dates=()):
    placed = cl.place_in_clusters(cl.day_clusters(photos(spark, rows)))
    return ch.select_heroes(placed, dates).collect()[0]["hero_photo_id"]


def test_hero_rules(spark):
    day = [{"ts": at(9 + i), "quality": q} for i, q in enumerate((0.2, 0.9, 0.4, 0.9))]
    assert hero(spark, day) == "p2"
    assert hero(spark, day, ["2025-05-01"]) == "p1"
    assert hero(spark, day, ["2025-05-02"]) == "p2"
    scored = [dict(r, aesthetic=a) for r, a in zip(day, (None, 0.1, None, 0.1))]
    assert hero(spark, scored, ["2025-05-01"]) == "p1"
    assert hero(spark, [{"ts": at(9)}, {"ts": at(10)}], ["2025-05-01"]) == "p1"


def test_upper_median_per_axis(spark):
    df = photos(spark, [{"ts": at(9), "lat": 1.0, "lng": 40.0}, {"ts": at(10), "lat": 2.0, "lng": 30.0},
                        {"ts": at(11), "lat": 3.0, "lng": 20.0}, {"ts": at(12), "lat": 4.0, "lng": 10.0}, {"ts": at(13)}])
    row = ch.build_chapters(cl.place_in_clusters(cl.day_clusters(df))).collect()[0]
    assert (row["lat"], row["lng"]) == (3.0, 30.0)
    assert row["chapter_id"] == "chapter_001" and row["date"] == "2025-05-01" and row["photo_count"] == 5


def test_no_coordinates_and_no_date(spark):
    row = ch.build_chapters(cl.place_in_clusters(cl.day_clusters(photos(spark, [{}])))).collect()[0]
    assert row["lat"] is None and row["date"] is None and row["hero_photo_id"] == "p0"


def test_chapter_id_is_not_cut(spark):
    assert spark.range(1).select(ch.chapter_id(F.lit(1233)).alias("c")).first()["c"] == "chapter_1234"


def test_dangling_bursts_are_dropped(spark):
    shown = spark.createDataFrame([("L", "a")], "library_id string, photo_id string")
    bursts = spark.createDataFrame([("L", "a", "x"), ("L", "gone", "y"), ("M", "a", "z")],
                                   "library_id string, rep_id string, photo_id string")
    assert [r["photo_id"] for r in ch.live_bursts(bursts, shown).collect()] == ["x"]


@pytest.mark.parametrize("strategy", ["day", "timeGap"])
def test_empty_input(spark, strategy):
    assert cl.place_in_clusters(cl.cluster(photos(spark, []), strategy)).count() == 0


def test_rounds_go_on_until_all_have_settled(spark, monkeypatch):
    import numpy as np

    from albumforge.operators import semantic as sm

    monkeypatch.setattr(sm, "MAX_ROUNDS", 1)
    vectors = np.random.default_rng(2).normal(size=(40, 4))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([("L", f"p{i}", i, v.tolist()) for i, v in enumerate(vectors)], "library_id string, photo_id string, ordinal long, embedding array<double>")
    rows = sm.kmeans(df, 3, max_rounds=None).collect()
    own = np.array([r["cluster"] for r in sorted(rows, key=lambda r: r["ordinal"])])
    means = np.stack([vectors[own == c].mean(axis=0) for c in range(3)])
    means /= np.linalg.norm(means, axis=1, keepdims=True)
    assert all(r["settled"] for r in rows) and ((vectors @ means.T).argmax(axis=1) == own).all()


@pytest.mark.parametrize("bound", [2**26, 0])
def test_no_plan_grows_with_the_rounds(spark, monkeypatch, bound):
    import numpy as np

    from albumforge.operators import semantic as sm

    plans, cut = [], sm.cut_lineage
    monkeypatch.setattr(sm, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().analyzed().toString()), cut(df))[1])
    monkeypatch.setattr(sm, "BROADCAST_BYTES", bound)
    vectors = np.random.default_rng(3).normal(size=(300, 4))
    df = spark.createDataFrame([(f"L{i % 2}", f"p{i}", i, v.tolist()) for i, v in enumerate(vectors)], "library_id string, photo_id string, ordinal long, embedding array<double>")
    joins = []
    for rounds in (2, 5):
        plans.clear()
        assert not any(r["settled"] for r in sm.kmeans(df, 6, max_rounds=rounds).collect())
        joins.append(max(plan.count("Join") for plan in plans))
    assert joins[0] == joins[1]


def test_rounds_on_the_driver_and_in_tables_agree(spark, monkeypatch):
    import numpy as np

    from albumforge.operators import semantic as sm

    # The third start of A has no members: it restarts from a drawn vector.
    monkeypatch.setattr(sm, "MAX_ROUNDS", 3)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(120, 4)) + np.array([3.0, 0, 0, 0])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [("A" if i < 60 else "B" if i < 117 else "few", f"p{i}", i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "library_id string, photo_id string, ordinal long, embedding array<double>")
    start = spark.createDataFrame([("A", [vectors[0].tolist(), vectors[1].tolist(), [-1.0, 0.0, 0.0, 0.0]]), ("B", vectors[60:63].tolist())],
                                  "library_id string, centroids array<array<double>>")
    found = {}
    for bound in (2**26, 0):
        monkeypatch.setattr(sm, "BROADCAST_BYTES", bound)
        for rounds in (1, 2, None):
            found[bound, rounds] = sorted((r["photo_id"], r["cluster"], r["settled"]) for r in sm.kmeans(df, 3, start, max_rounds=rounds).collect())
    for rounds in (1, 2, None):
        assert found[2**26, rounds] == found[0, rounds] and len(found[0, rounds]) == 120
    assert {c for p, c, _ in found[0, None] if int(p[1:]) < 60} == {0, 1, 2} and all(s for *_, s in found[0, None])
