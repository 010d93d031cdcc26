"""Event intake, replay, sources, strategies, models and streams."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from albumforge.functions import models
from albumforge.functions.scores import quartile_bucket, unit_clamp
from albumforge.functions.telemetry import browser_bucket, clean_properties
from albumforge.operators import curation, intake
from albumforge.plans import strategies
from albumforge.sources import itineraries, scored, telemetry, uploads
from albumforge.streaming import intake as live
from albumforge.streaming import photos as live_photos
from albumforge.streaming import usage
from albumforge.streaming.running import append_events, drain, use_rocksdb


def cleaned(spark, raw):
    return json.loads(spark.createDataFrame([(raw,)], "r string").select(clean_properties(F.col("r"))).first()[0])


def test_properties(spark):
    assert cleaned(spark, '{"a":1,"b":"x","c":[1],"d":{"e":1},"f":null,"g":true,"h":1.5}') == {"a": 1, "b": "x", "g": True, "h": 1.5}
    assert cleaned(spark, None) == {} and cleaned(spark, '"text"') == {} and cleaned(spark, "5") == {}
    assert cleaned(spark, '[7,"x",[1]]') == {"0": 7, "1": "x"}
    assert len(cleaned(spark, json.dumps({"s": "é" * 300}))["s"]) == 200


def test_twenty_keys_in_document_order(spark):
    body = {f"z{i}": None if i % 2 else i for i in range(30)} | {f"a{i}": i for i in range(30)}
    assert list(cleaned(spark, json.dumps(body))) == [f"z{i}" for i in range(0, 30, 2)] + [f"a{i}" for i in range(5)]
    # whole-number keys come before all others
    got = cleaned(spark, json.dumps({f"k{i}": 1 for i in range(20)} | {"7": "seven"}))
    assert got["7"] == "seven" and "k19" not in got


def requests(spark, bodies, times=None):
    start = datetime(2025, 1, 1)
    rows = [(i, times[i] if times else start + timedelta(seconds=i), "Firefox/1", b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, telemetry.BATCH_SCHEMA)


def event(session="s", name="n", **more):
    return {"session_id": session, "event_name": name, **more}


def test_reject_reasons(spark):
    ok = json.dumps({"events": [event()]})
    bodies = ["{", ok + "x", json.dumps({"events": []}), json.dumps({"events": [event()] * 51}), json.dumps({"events": "no"}),
              json.dumps({"events": [event(session=5), event(name="x" * 61), "text"]}), ok, json.dumps([1]), None]
    got = {r["batch_id"]: r["reject_reason"] for r in intake.batch_outcomes(requests(spark, bodies)).collect()}
    assert [got[i] for i in range(9)] == ["bad json", "bad json", "bad batch", "bad batch", "bad batch", "no valid events", None,
                                         "bad batch", "bad json"]


def test_event_rows_are_cut_and_typed(spark):
    e = event("s" * 100, "n" * 60, app_version="v" * 50, client_ts="2025-01-02T03:04:05Z", properties={"b": 1, "a": [2]})
    bodies = [json.dumps({"events": [e, event(app_version=3, client_ts=4), {"session_id": None, "event_name": "x"}]})]
    rows = intake.event_rows(intake.read_batches(requests(spark, bodies))).orderBy("event_no").collect()
    assert [len(r["session_id"]) for r in rows] == [80, 1] and [r["event_no"] for r in rows] == [0, 1]
    assert len(rows[0]["app_version"]) == 40 and rows[1]["app_version"] is None and rows[1]["client_ts"] is None
    assert rows[0]["properties"] == '{"b":1}' and rows[0]["ua_bucket"] == "firefox-desktop"


def limited(times, span, limit):
    """The rule as stated: requests inside the window before, rejected ones included."""
    return [sum(1 for u in times[:i + 1] if t - u < span) > limit for i, t in enumerate(times)]


def test_rate_limit_equals_count(spark):
    rnd = random.Random(2)
    t, times = 0, []
    for _ in range(400):
        t += rnd.choice((0, 1, 1, 2, 9, 30))
        times.append(t)
    start = datetime(2025, 1, 1)
    batches = spark.createDataFrame([("k", i, start + timedelta(seconds=s)) for i, s in enumerate(times)],
                                    "rate_key string, batch_id long, received_at timestamp")
    want = limited(times, 60, 12)
    got = {r["batch_id"]: r["rate_limited"] for r in intake.mark_rate(batches, 60, 12).collect()}
    assert [got[i] for i in range(400)] == want and any(want) and not all(want)
    counts = {r["batch_id"]: r["recent_requests"] for r in intake.recent_requests(batches, 60).collect()}
    assert [counts[i] > 12 for i in range(400)] == want


@pytest.mark.parametrize("agent,want", [
    ("Mozilla Chrome/1 Safari/1 Edg/1", "edge-desktop"), ("CriOS/1 Mobile Safari", "chrome-mobile"), ("FxiOS iPad", "firefox-mobile"),
    ("Version/17 Safari/605", "safari-desktop"), ("", "other-desktop"), (None, "other-desktop")])
def test_browser_buckets(spark, agent, want):
    assert spark.createDataFrame([(agent,)], "a string").select(browser_bucket(F.col("a"))).first()[0] == want


def test_missing_scores_stay_missing(spark):
    row = spark.createDataFrame([(None,)], "x double").select(quartile_bucket(F.col("x")).alias("q"), unit_clamp(F.col("x")).alias("c")).first()
    assert row["q"] is None and row["c"] is None


def test_replay_equals_loop(spark):
    rnd = random.Random(6)
    presses, started, want = [], {(lib, p) for lib in range(6) for p in range(4) if rnd.random() < 0.4}, {}
    state = {k: [True, 0] for k in started}
    for lib in range(6):
        for seq in range(rnd.randrange(60)):
            p, a = rnd.randrange(7), rnd.choice(("on", "off", "flip", "flip"))
            presses.append((lib, p, seq, a))
            s = state.setdefault((lib, p), [False, 0])
            s[0] = {"on": True, "off": False}.get(a, not s[0])
            s[1] += 1
    want = {k: (v[0], v[1] > 0, v[1]) for k, v in state.items()}
    df = spark.createDataFrame(presses, "library_id int, photo_id int, seq int, action string")
    starters = spark.createDataFrame(sorted(started), "library_id int, photo_id int")
    got = {(r["library_id"], r["photo_id"]): (r["kept"], r["touched"], r["presses"]) for r in curation.replay(df, starters).collect()}
    assert got == want


def test_image_listing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("x.jpg", "y.PNG", "z.txt", "a/w.heic"):
        (tmp_path / name).write_bytes(b"12345")
    got = uploads.list_images(spark, str(tmp_path)).select(F.regexp_extract("path", "[^/]+$", 0), "length").collect()
    assert sorted(map(tuple, got)) == [("w.heic", 5), ("x.jpg", 5), ("y.PNG", 5)]


def test_upload_limit(spark):
    rows = [(lib, i, f"{i}.jpg", 10) for lib in (1, 2) for i in range(600 if lib == 1 else 3)]
    df = spark.createDataFrame(rows, "library_id int, ordinal int, name string, length long")
    count = lambda d: {(r["library_id"], r["reject_reason"]): r["count"] for r in d.groupBy("library_id", "reject_reason").count().collect()}
    assert count(uploads.accept_uploads(df, most=uploads.FORM_FILES)) == {(1, None): 500, (1, "count"): 100, (2, None): 3}
    assert count(uploads.accept_uploads(df)) == {(1, None): 600, (2, None): 3}
    odd = spark.createDataFrame([(1, 0, None, 1), (1, 1, "a.gif", 1), (1, 2, "a.jpg", None), (1, 3, "a.jpg", 10**9), (1, 4, "b.PNG", 5)], df.schema)
    got = {r["ordinal"]: (r["accepted"], r["reject_reason"]) for r in uploads.accept_uploads(odd).collect()}
    assert got == {0: (False, "type"), 1: (False, "type"), 2: (False, "size"), 3: (False, "size"), 4: (True, None)}


def test_itinerary_file(spark, tmp_path):
    (tmp_path / "trip.json").write_text(json.dumps({"trip_name": "T", "events": [
        {"id": "e1", "date": "2025-03-15", "start_time": "08:00", "end_time": "09:00", "venue": "V"}, {"id": "e2", "date": ""}]}, indent=1))
    docs = itineraries.read_itineraries(spark, str(tmp_path)).withColumn("library_id", F.lit("L"))
    rows = itineraries.itinerary_events(docs).collect()
    assert [(r["ord"], r["event_id"], r["venue"]) for r in rows] == [(0, "e1", "V"), (1, "e2", None)]
    assert [(r["ord"], r["problem"]) for r in itineraries.itinerary_problems(docs).collect()] == [(1, "missing field")]


@pytest.mark.parametrize("reply,want", [
    ('{"score": 0.5, "keep": true, "reason": "ok"}', (0.5, True, "ok")), ('```json\n{"score": 2}\n```', (1.0, None, "")),
    ('```{"score": -1, "keep": "no", "reason": 3}```', (0.0, None, "")), ('{"score": "1"}', None), ("no", None), ("", None), (None, None)])
def test_model_reply(spark, reply, want):
    row = spark.createDataFrame([(reply,)], "r string").select(scored.parse_reply(F.col("r")).alias("x")).first()["x"]
    assert (tuple(row) if row else None) == want


def test_steps_of_ones_own(spark):
    strategies.offer("cluster", "all", lambda df, **_: df.withColumn("cluster_idx", F.lit(0)), reads=["id"], adds=["cluster_idx"])
    df = spark.range(3).transform(strategies.step("cluster", "all"))
    assert df.where("cluster_idx = 0").count() == 3 and "all" in strategies.offered("cluster")
    with pytest.raises(LookupError, match="nope"):
        strategies.step("cluster", "nope")
    with pytest.raises(ValueError):
        strategies.step("nope", "day")


def test_steps_are_held_to_their_contract(spark):
    strategies.offer("heroSelect", "lossy", lambda df: df.drop("id"))
    with pytest.raises(strategies.BrokenContract, match="gone"):
        strategies.step("heroSelect", "lossy")(spark.range(2))
    with pytest.raises(strategies.BrokenContract, match="not there"):
        strategies.step("cluster", "day")(spark.range(2))


def test_scoring_step_drops_no_photo(spark):
    rows = [("L", f"p{i}", i // 5, i, float(i), i != 9) for i in range(10)]
    placed = spark.createDataFrame(rows, "library_id string, photo_id string, cluster_idx int, pos int, variance double, has_file boolean")
    got = {r["photo_id"]: r["is_candidate"] for r in strategies.step("aestheticScore", "default")(placed).collect()}
    assert got == {f"p{i}": i in (2, 3, 4, 6, 7, 8) for i in range(10)}


def test_model_failures_become_null(spark):
    def make():
        def predict(x):
            if (x > 90).any():
                raise ValueError("bad picture")
            return x * 2
        return predict

    df = spark.range(96).repartition(1).sortWithinPartitions("id").select("id", F.col("id").cast("double").alias("x"))
    got = {r["id"]: r["s"] for r in df.select("id", models.model_scores(make, F.col("x")).alias("s")).collect()}
    assert got[3] == 6.0 and got[95] is None and got[79] == 158.0
    vec = df.where("id < 4").select("id", models.model_vectors(lambda: (lambda x: np.stack([x, -x], axis=1)), 2, F.col("x")).alias("v"))
    assert {r["id"]: list(r["v"]) for r in vec.collect()}[3] == [3.0, -3.0]


def test_unavailable_model_leaves_nulls(spark):
    placed = spark.createDataFrame([("L", "p", 1.0)], "library_id string, photo_id string, x double")
    out = models.score_candidates(placed, placed, None, ["x"], available=lambda: False)
    assert out.first()["aesthetic_score"] is None


def write_split(df, path, order, files=4):
    """Files that a one-file-per-trigger stream reads in order."""
    for i in range(files):
        df.where(F.floor(F.col(order) / (df.count() / files)) == i).coalesce(1).write.mode(
            "append").json(path)


def test_stream_limit_over_many_batches(spark, tmp_path):
    use_rocksdb(spark)
    rnd = random.Random(4)
    t, times = 0, []
    for _ in range(120):
        t += rnd.choice((0, 1, 5, 20))
        times.append(t)
    start = datetime(2025, 1, 1)
    df = spark.createDataFrame([("k", i, start + timedelta(seconds=s)) for i, s in enumerate(times)],
                               "rate_key string, batch_id long, received_at timestamp")
    path = str(tmp_path / "in")
    write_split(df, path, "batch_id")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(path)
    got = {r["batch_id"]: r["rate_limited"] for r in drain(live.rate_flags(stream, 60, 8)).collect()}
    assert [got[i] for i in range(120)] == limited(times, 60, 8)


def test_stream_walk_over_many_batches(spark, tmp_path):
    from test_dedup import library, loop

    use_rocksdb(spark)
    hashes = library(random.Random(9), 80, True)
    df = spark.createDataFrame([("L", i, f"p{i}", h) for i, h in enumerate(hashes)], "library_id string, name_no long, photo_id string, hash long")
    path = str(tmp_path / "in")
    write_split(df, path, "name_no")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(path)
    got = {r["photo_id"]: (r["status"], r["rep_id"], r["distance"], r["nearest_distance"]) for r in drain(live_photos.near_duplicates(stream)).collect()}
    assert got == loop([(f"p{i}", h) for i, h in enumerate(hashes)])


def test_stream_replay_over_many_batches(spark, tmp_path):
    use_rocksdb(spark)
    actions = [(0, 0, 0, "start"), (0, 0, 1, "flip"), (0, 1, 2, "on"), (0, 0, 3, "flip"), (0, 1, 4, "off"), (0, 1, 5, "flip"), (0, 2, 6, "flip"), (0, 2, 7, "off")]
    df = spark.createDataFrame(actions, "library_id int, photo_id int, seq long, action string")
    path = str(tmp_path / "in")
    write_split(df, path, "seq")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(path)
    updates = drain(usage.replay(stream), "update")
    last = {r["photo_id"]: tuple(r["s"]) for r in updates.groupBy("photo_id").agg(F.max_by(F.struct("kept", "presses"), "batch_no").alias("s")).collect()}
    assert last == {0: (True, 2), 1: (True, 3), 2: (False, 2)}


def test_events_are_appended_once(spark, tmp_path):
    use_rocksdb(spark)
    bodies = [json.dumps({"events": [event(f"s{i}", "n")] * (i % 3 + 1)}) for i in range(9)]
    path, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    requests(spark, bodies).coalesce(3).write.json(path)
    for _ in range(2):  # the second run finds nothing new
        rows = live.accepted_rows(telemetry.batch_stream(spark, path, files_per_trigger=1))
        append_events(rows, out, ck, available_now=True).awaitTermination()
    table = telemetry.read_events(spark, out, "n")
    assert table.count() == 18 and table.select("id").distinct().count() == 18


def test_limiter_calls_do_not_grow_with_keys(spark, tmp_path):
    use_rocksdb(spark)
    start = datetime(2025, 1, 1)
    # Three requests of each of 1,200 keys, in two files: the first two are within the limit, the third only where the first is too old.
    rows = [(f"k{i % 1200}", i, start + timedelta(seconds=i // 1200 * 20 + (60 if i >= 2400 and i % 2 else 0))) for i in range(3600)]
    df = spark.createDataFrame(rows, "rate_key string, batch_id long, received_at timestamp")
    path = str(tmp_path / "in")
    df.where("batch_id < 2000").coalesce(1).write.mode("append").json(path)
    df.where("batch_id >= 2000").coalesce(1).write.mode("append").json(path)
    ran = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(path)
    got = {r["batch_id"]: r["rate_limited"] for r in drain(live.rate_flags(stream, 60, 2), finished=ran).collect()}
    assert got == {i: i >= 2400 and i % 2 == 0 for i in range(3600)}
    # A list, its timer and the timer's index for each group, not for each key.
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in ran[0].recentProgress if p["stateOperators"]]
    assert 0 < max(totals) <= 3 * live.KEY_GROUPS < 1200


def test_batches_for_a_stream_are_put_together_once(spark, tmp_path, monkeypatch):
    from albumforge.catalog import streams

    made, text = spark.sparkContext.accumulator(0), json.dumps({"events": [event()]})

    @F.udf("string")
    def body(i):
        made.add(1)
        return text

    rows = spark.range(60).select(F.col("id").alias("batch_id"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("received_at"),
                                  F.lit("ua").alias("user_agent"), body("id").alias("body"))
    monkeypatch.setattr(streams, "raw_batches", lambda spark, sf: rows)
    monkeypatch.setattr(streams, "BATCHES_PER_FILE", 3)
    stream = streams.batch_stream(spark, str(tmp_path))
    assert made.value == 60
    assert sorted(r["batch_id"] for r in drain(stream).collect()) == list(range(60))


def test_events_that_are_no_objects_leave_no_row(spark):
    bodies = [json.dumps({"events": [7, "text", None, ["session_id"], {"session_id": {"a": 1}, "event_name": "n"}, event("s", "n")]})]
    assert [r["event_no"] for r in intake.event_rows(intake.read_batches(requests(spark, bodies))).collect()] == [5]
