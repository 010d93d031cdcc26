"""Streams over several micro-batches against the batch operators."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from albumforge.operators import curation
from albumforge.operators import metrics as m
from albumforge.operators.completion import completion_events, library_facts
from albumforge.streaming import completion as live
from albumforge.streaming import intake, photos, usage
from albumforge.streaming.running import drain, latest, slice_stream, use_rocksdb, watermark_of, write_slices

START = datetime(2025, 3, 1)


def sliced(spark, rows, schema, time, path, clock):
    """Rows as a stream of three slices, with a row that moves the clock on by a year."""
    df = spark.createDataFrame(rows, schema)
    write_slices(df, time, path, closing=spark.createDataFrame([clock], schema))
    return df, slice_stream(spark, df.schema, path)


def usage_rows(seed=5, sessions=40):
    """Presses, finishes again and again, and ways to leave; ids and times in seconds from the start."""
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        library, at = f"L{s % 6}", rng.randrange(20 * 86400)
        for _ in range(rng.randrange(12)):
            at += rng.randrange(1, 900)
            rows.append((library, f"s{s}", "press", f"p{rng.randrange(5)}", at))
        if rng.random() < 0.8:
            done = at + rng.randrange(1, 60)
            # The second finish comes soon, the third days after the watermark has passed the first.
            rows += [(library, f"s{s}", "finish", None, t) for t in (done, done + 100, done + 9 * 86400)[:rng.randrange(1, 4)]]
            at = done
        for kind in ("back", "tab_close"):
            if rng.random() < 0.6:
                rows.append((library, f"s{s}", kind, None, at + rng.choice([-5, 1, 400])))
    return rows


def test_completions_and_bail_outs_equal_batch(spark, tmp_path):
    use_rocksdb(spark)
    rows = [(lib, s, kind, photo, START + timedelta(seconds=t)) for lib, s, kind, photo, t in usage_rows()]
    schema = "library_id string, session_id string, kind string, photo_id string, at timestamp"
    df, stream = sliced(spark, rows, schema, "at", f"{tmp_path}/in", (None, "-", "clock", None, START + timedelta(days=400)))
    library = spark.createDataFrame([(f"L{i % 6}", i % 2 == 0, i % 3 == 0, i / 50) for i in range(40)], "library_id string, is_auto boolean, is_kept boolean, quality double")
    uploaded = library.groupBy("library_id").agg(F.count("*").alias("uploaded"))

    def of(name, *kinds):
        timed = stream.withColumnRenamed("at", name).withWatermark(name, "1 hour")
        return live.of_kind(timed, name, F.col("kind").isin(*kinds))

    finishes = of("finished_at", "finish").select("library_id", "session_id", "finished_at", F.lit(START).alias("started_at"))
    presses = of("pressed_at", "press").select("session_id", "photo_id", "pressed_at")
    live.record_completions(live.finished_sessions(finishes, presses, "2 days"), library_facts(library, uploaded), f"{tmp_path}/table", f"{tmp_path}/ck", available_now=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/table")
    # One session is one library's only one in each batch run: presses count by session.
    by_session = df.withColumns({"library": F.col("library_id"), "library_id": F.col("session_id")})
    done = by_session.where("kind = 'finish'").select("library_id", "session_id", F.col("at").alias("finished_at"), F.lit(START).alias("started_at"))
    pressed = by_session.where("kind = 'press'").select("library_id", "photo_id", F.unix_micros("at").alias("seq"), F.lit("flip").alias("action"))
    want = completion_events(done, pressed, library.withColumn("library_id", F.lit("none")), uploaded.withColumn("library_id", F.lit("none")))
    keep = [m.CURATION_DURATION, m.TOGGLE_COUNT]
    rows_of = lambda d: sorted(tuple(r) for r in d.where(F.col("event_name").isin(keep)).select("session_id", "server_ts", "event_name", "properties").collect())
    assert rows_of(got) == rows_of(want) and got.count() == 2 * len(rows_of(got))
    funnel = {r["library_id"]: json.loads(r["properties"]) for r in got.where(F.col("event_name") == m.CURATION_FUNNEL).collect()}
    assert funnel["L1"]["uploaded"] == 7 and len(funnel) == 6

    # The clock is a leaf of no kind, and is a finish of no session.
    leaves = of("left_at", "back", "tab_close").select("session_id", "kind", "left_at")
    late = drain(live.bail_outs(leaves, finishes.select("session_id", "finished_at"), "2 days"))
    seq = F.unix_micros("at").alias("seq")
    batch = curation.bail_outs(df.where("kind IN ('back', 'tab_close')").select("session_id", "kind", seq), df.where("kind = 'finish'").select("session_id", seq))
    assert sorted((r["session_id"], r["kind"], r["us"]) for r in late.withColumn("us", F.unix_micros("left_at")).collect()) == sorted((r["session_id"], r["kind"], r["seq"]) for r in batch.collect())


def test_limiter_forgets_keys(spark, tmp_path):
    use_rocksdb(spark)
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(9)}", i, START + timedelta(seconds=60 * i + rng.randrange(50))) for i in range(300)]
    df, stream = sliced(spark, rows, "rate_key string, batch_id long, received_at timestamp", "received_at", f"{tmp_path}/in", (None, None, START + timedelta(days=400)))
    ran = []
    got = {r["batch_id"]: r["rate_limited"] for r in drain(intake.rate_flags(stream, 3600, 5), finished=ran).collect()}
    times = {}
    for key, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        earlier = times.setdefault(key, [])
        assert got.pop(i) == (sum(at - t < timedelta(seconds=3600) for t in earlier) >= 5)
        earlier.append(at)
    assert not got
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in ran[0].recentProgress if p["stateOperators"]]
    assert max(totals) > 0 and totals[-1] == 0


def test_busy_library_is_walked_in_pieces(spark, tmp_path):
    from test_dedup import library, loop

    use_rocksdb(spark)
    own = {"busy": library(random.Random(3), 400, True), "quiet": library(random.Random(4), 40, True)}
    rows = [(lib, i, f"{lib}{i}", h) for lib, hashes in own.items() for i, h in enumerate(hashes)] + [("late", 399, "late0", 5)]
    df = spark.createDataFrame(rows, "library_id string, name_no long, photo_id string, hash long")
    write_slices(df, "name_no", f"{tmp_path}/in", slices=5)
    stream = slice_stream(spark, df.schema, f"{tmp_path}/in")
    photos.record_near_duplicates(stream, f"{tmp_path}/out", f"{tmp_path}/ck", available_now=True, partitions=6).awaitTermination()
    got = {r["photo_id"]: (r["status"], r["rep_id"], r["distance"], r["nearest_distance"]) for r in photos.recorded_near_duplicates(spark, f"{tmp_path}/out").collect()}
    assert got == {**{k: v for lib, hashes in own.items() for k, v in loop([(f"{lib}{i}", h) for i, h in enumerate(hashes)]).items()}, "late0": ("kept", None, None, None)}


def test_percentiles_of_open_and_closed_days(spark, tmp_path):
    use_rocksdb(spark)
    rng = np.random.default_rng(3)
    ms = {day: rng.lognormal(8, 1.5, 6000).round().astype(int).tolist() for day in range(3)}
    rows = [(m.TIME_TO_CURATION, START + timedelta(days=day, seconds=i * 14), json.dumps({"ms": v})) for day, values in ms.items() for i, v in enumerate(values)]
    rows += [(m.TIME_TO_CURATION, START, "{}"), ("other", START, '{"ms": 5}')]
    df = spark.createDataFrame(rows, "event_name string, server_ts timestamp, properties string").repartition(8)
    write_slices(df, "server_ts", f"{tmp_path}/in")
    stream = slice_stream(spark, df.schema, f"{tmp_path}/in").withWatermark("server_ts", "1 hour")
    ran = []
    sketches = latest(drain(usage.day_sketches(usage.timing_values(stream, "time_to_curation")), "update", ran), ["day", "stage"]).cache()
    values = usage.timing_values(df, "time_to_curation").withColumn("day", F.to_date("server_ts"))
    exact = {r["day"].day: r for r in m.timing_by_day(df, m.TIME_TO_CURATION).collect()}
    rank = lambda day, v: np.searchsorted(np.sort(ms[day]), v) / 6000
    for r in usage.sketched_timings(sketches, ["day"]).collect():
        day = r["day"].day - 1
        assert (r["samples"], r["avg_ms"]) == (exact[day + 1]["samples"], exact[day + 1]["avg_ms"])
        assert abs(rank(day, r["p50_ms"]) - 0.5) <= usage.RANK_ERROR and abs(rank(day, r["p95_ms"]) - 0.95) <= usage.RANK_ERROR
    merged = usage.sketched_timings(sketches, ["stage"]).first()
    assert abs(np.searchsorted(np.sort(sum(ms.values(), [])), merged["p50_ms"]) / 18000 - 0.5) <= usage.RANK_ERROR
    # The first two days have ended for the watermark; the last one is open.
    now = {r["day"].day: r for r in usage.timings_now(sketches, values, watermark_of(ran[0])).collect()}
    assert sorted(now) == [1, 2, 3] and [now[1], now[2]] == [exact[1], exact[2]]
    # A day's state is a sketch, not its samples.
    assert sketches.agg(F.max(F.length("sketch"))).first()[0] < 40_000


def test_settled_events_skip_other_names(spark, tmp_path):
    from albumforge.sources import telemetry

    rng = random.Random(6)
    rows = [(f"name{rng.randrange(40)}", START + timedelta(seconds=rng.randrange(2 * 86400)), json.dumps({"ms": i, "s": "x"})) for i in range(20_000)]
    df = spark.createDataFrame(rows, "event_name string, server_ts timestamp, properties string")
    path = f"{tmp_path}/table"
    for _ in range(2):
        telemetry.settle_events(df.repartition(4), path)
    # One day again, with fewer rows: only that day changes.
    telemetry.settle_events(df.where("to_date(server_ts) = '2025-03-02' AND event_name < 'name2'"), path)
    want = sorted((r[0], r[1], json.loads(r[2])["ms"]) for r in rows if r[1].day == 1 or r[0] < "name2")
    found = telemetry.settled_events(spark, path)
    assert sorted((r["event_name"], r["server_ts"], json.loads(r["properties"])["ms"]) for r in found.collect()) == want
    one = telemetry.read_events(spark, path, "name7").where("day = '2025-03-01'")
    assert one.count() == sum(w[0] == "name7" and w[1].day == 1 for w in want)
    plan = one.select("event_name", "properties")._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "EqualTo(event_name,name7)" in text and "PartitionFilters: [isnotnull(day" in text and "variant" in text


def test_replay_of_a_table_in_parts(spark, tmp_path):
    from albumforge.catalog.registry import QUERIES
    from albumforge.catalog import streams  # noqa: F401

    rows = [(c, t, ("user", "assistant", "system")[(c + t) % 3]) for c in range(20) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string")
    one, parts = f"{tmp_path}/one", f"{tmp_path}/parts"
    df.coalesce(1).write.parquet(f"{one}/out")
    next((tmp_path / "one" / "out").glob("part-*.parquet")).rename(tmp_path / "one" / "conversations.parquet")
    df.repartition(4).write.parquet(f"{parts}/conversations.parquet")
    got = [sorted(map(tuple, QUERIES["stream_replayed_choices"](spark, sf).collect())) for sf in (one, parts)]
    assert got[0] == got[1] and len(got[0]) == 60
    assert {r[3] for r in got[0]} == {3}


def test_near_duplicates_of_a_table_in_parts(spark, tmp_path):
    from albumforge.catalog import streams  # noqa: F401
    from albumforge.catalog.registry import QUERIES

    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=64).round(3).tolist(), i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["stream_near_duplicates"](spark, str(tmp_path)).collect()
    batch = QUERIES["near_duplicates"](spark, str(tmp_path)).collect()
    assert sorted(r["photo_id"] for r in got) == sorted(f"photo_{i}" for i in range(120))
    assert {r["photo_id"]: (r["status"], r["rep_id"], r["distance"]) for r in got} == {r["photo_id"]: (r["status"], r["rep_id"], r["distance"]) for r in batch}


def test_sessions_that_finish_often_report_once(spark, tmp_path):
    rng = random.Random(12)
    rows = [("L", f"s{i % 3}", kind, f"p{rng.randrange(40)}" if kind == "press" else None, START + timedelta(seconds=rng.randrange(40 * 86400)))
            for i in range(1500) for kind in ("press", "finish")]
    rows += [("L", "never", "press", "p1", START), ("L", "alone", "finish", None, START + timedelta(days=3)),
             # Two presses at the edges of the longest session, one just outside.
             ("L", "edge", "finish", None, START + timedelta(days=9)), ("L", "edge", "press", "p1", START + timedelta(days=9)),
             ("L", "edge", "press", "p2", START + timedelta(days=7)), ("L", "edge", "press", "p3", START + timedelta(days=7) - timedelta(microseconds=1))]
    schema = "library_id string, session_id string, kind string, photo_id string, at timestamp"
    df, stream = sliced(spark, rows, schema, "at", f"{tmp_path}/in", (None, None, "clock", None, START + timedelta(days=400)))
    library = spark.createDataFrame([("L", True, True, 0.5)], "library_id string, is_auto boolean, is_kept boolean, quality double")
    facts = library_facts(library, library.groupBy("library_id").agg(F.count("*").alias("uploaded")))
    started = spark.createDataFrame([("s0", START - timedelta(seconds=2))], "session_id string, started_at timestamp")
    ran = live.record_usage(stream, started, facts, f"{tmp_path}/out", f"{tmp_path}/ck", "2 days", "1 hour", available_now=True)
    ran.awaitTermination()
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out/table").collect():
        assert (r["session_id"], r["event_name"]) not in got
        got[r["session_id"], r["event_name"]] = (r["server_ts"], json.loads(r["properties"]))
    for s in ("s0", "s1", "s2", "alone", "edge"):
        done = min(r[4] for r in rows if r[1] == s and r[2] == "finish")
        near = [r[3] for r in rows if r[1] == s and r[2] == "press" and done - timedelta(days=2) <= r[4] <= done]
        assert got[s, m.TOGGLE_COUNT] == (done, {"presses": len(near), "distinctPhotos": len(set(near))})
        assert ((s, m.CURATION_DURATION) in got) == (s == "s0")
    assert {s for s, _ in got} == {"s0", "s1", "s2", "alone", "edge"}
    assert not any(p["stateOperators"] for p in ran.recentProgress)
