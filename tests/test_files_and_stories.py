"""Crowded itinerary days, stories after curation, stored documents, files on disk."""

import hashlib
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from albumforge.operators import documents as doc
from albumforge.operators import itinerary as it
from albumforge.plans.stories import curated_story
from albumforge.sources import uploads

DAY = datetime(2025, 6, 1)


def test_sweep_equals_looking_at_every_event():
    rng = random.Random(1)
    for n in (0, 1, 5, 200):
        events = []
        for i in range(n):
            a = rng.randrange(1441)
            events.append({"event_id": f"e{i}", "_from": a, "_to": min(1440, a + rng.choice([0, 1, 30, 600]))})
        first = lambda test: next((e["event_id"] for e in events if test(e)), None)
        got = it.sweep(events)
        assert [p["at"] for p in got] == sorted({e[c] for e in events for c in ("_from", "_to")})
        for p in got:
            b = p["at"]
            assert p["here"] == first(lambda e: e["_from"] <= b <= e["_to"])
            assert p["after"] == first(lambda e: e["_from"] <= b < e["_to"])


def test_crowded_day(spark):
    rng = random.Random(2)
    clock = lambda m: f"{m // 60:02d}:{m % 60:02d}"
    rows = []
    for i in range(20_000):
        a = rng.randrange(300, 1380)
        rows.append(("L", f"e{i}", 20_000 - i, "2025-06-01", clock(a), clock(a + rng.randrange(3))))
    events = spark.createDataFrame(rows, "library_id string, event_id string, ord int, date string, start_time string, end_time string")
    photos = spark.createDataFrame([("L", i, DAY + timedelta(seconds=i * 43)) for i in range(2000)], "library_id string, ordinal long, ts timestamp")
    got = {r["ordinal"]: r["event_id"] for r in it.match_events(photos, events).collect()}
    best = {}
    minutes = lambda c: int(c[:2]) * 60 + int(c[3:])
    spans = [(ord_, e, minutes(a) * 60, minutes(b) * 60) for _, e, ord_, _, a, b in rows]
    for ord_, e, a, b in spans:
        for i in range(-(-a // 43), b // 43 + 1):
            if i < 2000 and (i not in best or best[i][0] > ord_):
                best[i] = (ord_, e)
    assert got == {i: best[i][1] if i in best else it.OTHER for i in range(2000)}


def test_story_of_what_was_kept(spark):
    located = spark.createDataFrame(
        [("A", 0, "chapter_001", 2, "a1", 10.0, 10.0, "Porto", "Portugal"), ("A", 1, "chapter_002", 2, "a3", 10.1, 10.0, "", None),
         ("A", 2, "chapter_003", 1, "a5", 10.2, 10.0, "Vigo", "Spain"), ("B", 0, "chapter_001", 1, "b1", None, None, None, None)],
        "library_id string, cluster_idx int, chapter_id string, photo_count long, hero_photo_id string, lat double, lng double, label string, country string")
    photos = spark.createDataFrame(
        [("A", 0, i % 2, f"a{i + 1}", "portrait", 0.5) for i in range(2)] + [("A", 1, i % 2, f"a{i + 3}", "landscape", None) for i in range(2)]
        + [("A", 2, 0, "a5", "landscape", 0.1), ("B", 0, 0, "b1", "portrait", 0.2)],
        "library_id string, cluster_idx int, pos long, photo_id string, orientation string, quality double")
    meta = spark.createDataFrame([("A", 5, DAY.date(), DAY.date()), ("B", 1, None, None)], "library_id string, photos long, start_date date, end_date date")
    kept = photos.where("photo_id IN ('a2', 'a4')")
    made = curated_story(located, photos, kept, meta)
    # The second day's lead photo went; the third day is gone, but its country still names the trip.
    assert [(r["library_id"], r["day_index"], r["title"], r["hero_photo_id"], r["photo_count"]) for r in made.chapters.orderBy("day_index").collect()] == [
        ("A", 1, "Day 1 — Porto", "a2", 1), ("A", 2, "Day 2", "a4", 1)]
    cover = made.covers.collect()
    assert [(r["library_id"], r["trip_name"], r["stat"]) for r in cover] == [("A", "Spain, June 2025", "5 photos taken")]
    frames = made.frames.orderBy("frame_no").collect()
    assert [r["type"] for r in frames] == ["cover", "chapterDivider", "photoCard", "chapterDivider", "photoCard", "coda"]
    assert [r["start_ms"] for r in frames] == [None, 0, 2000, 4000, 6000, 8000] and frames[1]["top_photo_id"] == frames[1]["bottom_photo_id"] == "a2"
    nothing = curated_story(located, photos, photos.where("false"), meta)
    assert nothing.frames.collect() == [] and nothing.covers.collect() == []


def test_replacing_one_library_leaves_others(spark, tmp_path):
    path = f"{tmp_path}/docs"
    parts = lambda lib, word, n: spark.createDataFrame([(lib, s, "", i, f"{word}{i}") for s in ("meta", "photos") for i in range(n)],
                                                       "library_id string, section string, owner string, part long, body string")
    doc.replace_documents(parts("A", "old", 3).unionByName(parts("B", "b", 2)), path)
    files = {f for f in (tmp_path / "docs" / "library_id=B").iterdir()}
    for _ in range(2):  # a second run of the same job changes nothing
        doc.replace_documents(parts("A", "new", 2), path)
    got = sorted((r["library_id"], r["section"], r["body"]) for r in doc.read_documents(spark, path).collect())
    assert got == sorted([("A", s, f"new{i}") for s in ("meta", "photos") for i in range(2)] + [("B", s, f"b{i}") for s in ("meta", "photos") for i in range(2)])
    assert {f for f in (tmp_path / "docs" / "library_id=B").iterdir()} == files
    assert {r["section"] for r in doc.read_documents(spark, path, "meta").collect()} == {"meta"}


def test_files_are_listed_by_name_and_size(spark, tmp_path):
    names = ["a/x.jpg", "a/y.JPEG", "b/c/z.png", "w.txt", "big.tiff", "empty.heic", "v.jpgx"]
    rows = [(n, b"" if n.startswith("empty") else b"z" * (5000 if n.startswith("big") else 7)) for n in names]
    uploads.write_files(spark.createDataFrame(rows, "name string, content binary"), f"{tmp_path}/up")
    found = uploads.list_images(spark, f"{tmp_path}/up", 100)
    got = {r["path"].rpartition("/")[2]: bytes(r["content"]) for r in found.collect()}
    assert got == {"x.jpg": b"z" * 7, "y.JPEG": b"z" * 7, "z.png": b"z" * 7}
    plan = found.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan and "content" not in plan.split("ReadSchema")[1]


def test_small_files_share_tasks(spark, tmp_path):
    from albumforge.sources import uploads

    rows = [(f"{i % 3}/{i // 100}/img{i}.jpg", bytes([i % 256]) * 50) for i in range(600)]
    uploads.write_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path))
    found = uploads.list_images(spark, str(tmp_path))
    assert found.count() == 600 and found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism


def test_parts_are_made_once_when_documents_are_replaced(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(i):
        made.add(1)
        return f"[{i}]"

    i = F.col("id")
    parts = spark.range(200).select((i % 4).alias("library_id"), F.lit("photos").alias("section"), F.lit("").alias("owner"), i.alias("part"), body("id").alias("body"))
    doc.replace_documents(parts, f"{tmp_path}/documents")
    assert made.value == 200
    got = doc.read_documents(spark, f"{tmp_path}/documents", "photos").collect()
    assert sorted((r["part"], r["library_id"], r["body"]) for r in got) == [(n, n % 4, f"[{n}]") for n in range(200)]


def test_a_photo_named_twice_is_held_once(spark):
    from albumforge.operators import chapters as ch

    photos = spark.createDataFrame([(1, f"p{n}", n) for n in range(5)], "library_id int, photo_id string, ordinal int")
    listed = spark.createDataFrame([(1, "p0"), (1, "p0"), (1, "p3")], "library_id int, photo_id string")
    bursts = spark.createDataFrame([(1, "p1", "p0"), (1, "p3", "p0"), (1, "p2", "p4")], "library_id int, photo_id string, rep_id string")
    assert sorted(r["photo_id"] for r in doc.photo_map(photos, listed, bursts).collect()) == ["p0", "p1", "p3"]
    assert sorted(r["photo_id"] for r in ch.live_bursts(bursts, listed).collect()) == ["p1", "p3"]


def test_sizes_of_long_pages_are_64_bit(spark, tmp_path):
    from albumforge.catalog import uploads as queries

    rows = [(0, "u", "x" * 107_375), (3, "u", "x" * 2_621), (6, "u", "x" * 2_622), (9, "u", "x" * 150_000), (12, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["ordinal"]: (r["name"], r["reject_reason"], r["accepted"]) for r in queries.accepted_uploads(spark, str(tmp_path)).collect()}
    assert got == {0: ("img0.jpg", "size", False), 3: ("img3.gif", "type", False), 6: ("img6.tiff", "size", False),
                   9: ("img9.jpg", "size", False), 12: ("img12.gif", "type", False)}


def test_the_driver_holds_no_list_of_files(spark, tmp_path):
    rows = [(f"{i % 4}/{i // 40}/img{i}.jpg", bytes([i % 256]) * 50) for i in range(400)]
    uploads.write_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path))
    found = uploads.list_images(spark, f"file://{tmp_path}/")
    assert len(found.inputFiles()) < 50
    assert {r["path"]: bytes(r["content"]) for r in found.collect()} == {f"file:{tmp_path}/{n}": c for n, c in rows}


def test_listing_equals_the_reader_of_spark(spark, tmp_path):
    root = tmp_path / "up"
    names = ("_x/q.jpg", ".h/q.jpg", "a b%20c/z.jpg", "a b%20c/_k=1/k.heif", "é/ü 1.PNG", ".d.jpg", "_u.jpg", "_u=1.jpg", "x.JPG", "jpg", "a.b.tiff",
             "n\nl.jpg", "s[1].jpg", "_metadata/m.webp", "_metadata.jpg", "deep/er/and/deeper/d.jpeg", "c._COPYING_/c.jpg", "none/.keep", "x.jpg.txt", "y.jpg ")
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())
    (root / "e.jpg").touch()
    (root / "link.jpg").symlink_to(root / "x.JPG")
    (root / "broken.jpg").symlink_to(root / "nothing")
    (root / "linked").symlink_to(root / "é")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG],[hH][eE][iI][cCfF],[wW][eE][bB][pP],[tT][iI][fF][fF]}")
    columns = ["path", "modificationTime", "length", "content"]
    found = uploads.list_images(spark, str(root))
    assert found.schema == reader.load(str(root)).schema
    got, want = (sorted(map(tuple, df.select(*columns).collect())) for df in (found, reader.load(str(root))))
    assert got == want and len(got) == 12
    one = uploads.list_images(spark, f"{root}/x.JPG").select(*columns).collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in reader.load(f"{root}/x.JPG").select(*columns).collect()]
    assert uploads.list_images(spark, f"{root}/none").count() == 0


def test_large_files_come_in_batches_of_their_own(spark, tmp_path):
    for i in range(7):
        (tmp_path / f"{i}.png").write_bytes(bytes([i]) * (5_000_000 + i))
    found = uploads.list_images(spark, str(tmp_path), 5_000_005).coalesce(1)
    got = {r["n"]: (r["length"], r["s"]) for r in found.select(F.regexp_extract("path", "([0-9]).png", 1).alias("n"), "length", F.sha2("content", 256).alias("s")).collect()}
    assert got == {str(i): (5_000_000 + i, hashlib.sha256(bytes([i]) * (5_000_000 + i)).hexdigest()) for i in range(6)}
