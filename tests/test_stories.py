"""Distances, names, layouts, frames, exports, documents."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from albumforge.functions import text as tx
from albumforge.functions.geo import haversine_km
from albumforge.operators import checks, documents, itinerary, story


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_haversine(spark):
    assert one(spark, haversine_km(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))) == 0
    # Bali to Singapore and on: about 2,300 km between (-8.65, 115.2) and (10.8, 106.7)
    assert 2200 < one(spark, haversine_km(F.lit(-8.65), F.lit(115.2), F.lit(10.8), F.lit(106.7))) < 2400


def chapters(spark, rows):
    return spark.createDataFrame([("L", i, *r) for i, r in enumerate(rows)], "library_id string, cluster_idx int, lat double, lng double")


def test_pairs_without_coordinates_are_skipped(spark):
    km = lambda rows: story.travelled_km(chapters(spark, rows)).first()["distance_km"]
    assert km([(0.0, 0.0), (0.0, 1.0)]) == 111
    assert km([(0.0, 0.0), (None, None), (0.0, 1.0)]) == 0
    assert km([(0.0, 0.0)]) == 0


@pytest.mark.parametrize("start,end,country,want", [
    ("2025-05-03", "2025-05-13", None, "May 2025"), ("2025-05-28", "2025-06-05", "Japan", "Japan, May–June 2025"),
    ("2024-12-28", "2025-01-02", "", "December–January 2025"), ("2024-05-01", "2025-05-01", None, "May 2025"),
    (None, None, "Peru", "Peru"), (None, None, None, "Your Story"),
])
def test_trip_names(spark, start, end, country, want):
    day = lambda d: F.lit(d).cast("date")
    assert one(spark, tx.trip_name(day(start), day(end), F.lit(country).cast("string"))) == want


@pytest.mark.parametrize("start,end,want", [
    ("2025-05-03", "2025-05-13", "May 3–13, 2025"), ("2025-05-28", "2025-06-05", "May 28 – June 5, 2025"), (None, None, "Undated")])
def test_date_labels(spark, start, end, want):
    day = lambda d: F.lit(d).cast("date")
    assert one(spark, tx.date_range_label(day(start), day(end))) == want


def test_headlines(spark):
    h = lambda km, n: one(spark, story.headline(F.lit(km), F.lit(n))["value"])
    assert h(2345, 9) == "2,345km travelled" and h(50, 9) == "50km travelled"
    assert h(49, 1200) == "1,200 photos taken" and h(0, 1) == "1 photo taken"


@pytest.mark.parametrize("sides,hero,layout,ids", [
    ("PPPPL", 0, "portrait-4", [0, 1, 2, 3]), ("LLLP", 1, "landscape-3", [1, 0, 2]), ("PPL", 0, "mixed-2p-1l", [0, 1, 2]),
    ("LPP", 0, "mixed-2p-1l", [1, 2, 0]), ("LLP", 0, "landscape-2", [0, 1]), ("LL", 1, "landscape-2", [1, 0]),
    ("P", 0, "portrait-1", [0]), ("PP", 0, "portrait-1", [0]), ("?LLPPP", 0, "portrait-1", [0])])
def test_layouts(spark, sides, hero, layout, ids):
    side = {"P": "portrait", "L": "landscape", "?": None}
    photos = spark.createDataFrame([("L", 0, i, f"p{i}", side[s], None) for i, s in enumerate(sides)],
                                   "library_id string, cluster_idx int, pos long, photo_id string, orientation string, quality double")
    heads = spark.createDataFrame([("L", 0, f"p{hero}")], "library_id string, cluster_idx int, hero_photo_id string")
    row = story.card_layouts(photos, heads).first()
    assert (row["layout"], row["photo_ids"]) == (layout, [f"p{i}" for i in ids])


def test_missing_lead_photo_is_reported(spark):
    photos = spark.createDataFrame([("L", 0, 0, "p0", "portrait", 0.5)],
                                   "library_id string, cluster_idx int, pos long, photo_id string, orientation string, quality double")
    heads = spark.createDataFrame([("L", 0, "gone")], "library_id string, cluster_idx int, hero_photo_id string")
    row = story.card_layouts(photos, heads).first()
    assert row["layout"] is None and row["problem"] == "lead photo not in chapter"


def test_titles(spark):
    strip = lambda title, day: one(spark, tx.strip_day_prefix(F.lit(title), F.lit(day)))
    assert strip("Day 2 — Kyoto", 2) == "Kyoto" and strip("Day 2", 2) == "Day 2" and strip("Arrival", 1) == "Arrival"
    assert strip(None, 1) == "" and strip("Day 12", 1) == "2"


@pytest.mark.parametrize("parts,want", [
    (dict(neighbourhood="Gion", city="Kyoto", country="Japan"), "Gion, Kyoto"), (dict(suburb="Kyoto", city="Kyoto"), "Kyoto"),
    (dict(town="Nara"), "Nara"), (dict(quarter="Old", country="Peru"), "Peru"), (dict(neighbourhood="", city=""), None)])
def test_place_labels(spark, parts, want):
    names = ("neighbourhood", "suburb", "quarter", "town", "city", "village", "municipality", "country")
    assert one(spark, tx.place_label(*[F.lit(parts.get(n)).cast("string") for n in names])) == want


@pytest.mark.parametrize("minutes,want", [(20.0, "20m"), (90.0, "90m"), (90.5, "1.5h"), (120.0, "2h"), (20.5, "21m")])
def test_gap_text(spark, minutes, want):
    assert one(spark, tx.gap_text(F.lit(minutes))) == want


def test_natural_order(spark):
    names = ["IMG_10.jpg", "IMG_2.jpg", "img_1.jpg", "IMG_002b.jpg", "a.jpg", "IMG_12345678901234567890123.jpg", "IMG_12345678901234567890122.jpg"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["n"] for r in df.orderBy(tx.natural_key(F.col("n"))).collect()]
    assert got == ["a.jpg", "img_1.jpg", "IMG_2.jpg", "IMG_002b.jpg", "IMG_10.jpg",
                   "IMG_12345678901234567890122.jpg", "IMG_12345678901234567890123.jpg"]


@pytest.mark.parametrize("before,after", [("photo 10.jpg", "photo2.jpg"), ("img_1.jpg", "img1.jpg"), ("a-1.jpg", "a1.jpg"), ("a.jpg", "a1.jpg"),
                                          ("a1.jpg", "ab.jpg"), ("IMG_9", "img_10"), ("a", "a b"), ("a2b10", "a2b011")])
def test_natural_order_of_pairs(spark, before, after):
    df = spark.createDataFrame([(after,), (before,)], "n string")
    assert [r["n"] for r in df.orderBy(tx.natural_key(F.col("n"))).collect()] == [before, after]


def test_export_numbers_skip_what_is_not_exported(spark):
    kept = spark.createDataFrame(
        [("L", 0, "a", "Beach day.PNG", datetime(2025, 5, 2), None, None), ("L", 1, "b", "x.jpg", datetime(2025, 5, 1), None, None),
         ("L", 2, "c", None, None, "data:h", "data:t"), ("L", 3, "d", "..", datetime(2025, 5, 3), "", "data:t")],
        "library_id string, ordinal int, photo_id string, name string, ts timestamp, thumbnail_hero_url string, thumbnail_url string")
    originals = spark.createDataFrame([("L", "a", "DSC.JPEG")], "library_id string, photo_id string, original_name string")
    got = [(r["file_name"], r["source"]) for r in documents.export_manifest(kept, originals).orderBy("number").collect()]
    assert got == [("01-photo.jpg", "hero_thumbnail"), ("02-Beach-day.jpeg", "original"), ("03-photo.jpg", "thumbnail")]


def document_tables(spark):
    photos = spark.createDataFrame(
        [("L", i, f"p{i}", f"IMG_{i}.jpg", datetime(2025, 5, 1 + i), 1.0 if i else None, 2.0 if i else None, 0.5) for i in range(5)],
        "library_id string, ordinal int, photo_id string, name string, ts timestamp, lat double, lng double, quality double")
    placed = photos.where("ordinal < 4").selectExpr("*", "0 AS cluster_idx", "CAST(ordinal AS LONG) AS pos", "'chapter_001' AS chapter_id")
    heads = spark.createDataFrame([("L", 0, "chapter_001", "p2", "2025-05-01", 1.0, 2.0)],
                                  "library_id string, cluster_idx int, chapter_id string, hero_photo_id string, date string, lat double, lng double")
    bursts = spark.createDataFrame([("L", "p0", "p4", 0)], "library_id string, rep_id string, photo_id string, candidate_no long")
    mapped = documents.photo_map(photos, placed, bursts)
    surveys = spark.createDataFrame([("L", "Trip", 3)], "library_id string, trip_name string, target_count long")
    return mapped, heads, placed, bursts, documents.document_meta(photos, placed, mapped, heads, surveys)


def test_nested_document(spark):
    docs = documents.nested_documents(*document_tables(spark))
    body = json.loads(docs.first()["body"])
    assert set(body["photos"]) == {f"p{i}" for i in range(5)}
    assert body["chapters"][0]["photoIds"] == ["p0", "p1", "p2", "p3"] and body["chapters"][0]["heroPhotoId"] == "p2"
    assert body["burstGroups"] == [{"representativeId": "p0", "candidateIds": ["p4"]}]
    assert body["meta"]["totalPhotosInput"] == 5 and body["meta"]["totalPhotosAfterDedup"] == 4
    assert body["meta"]["dateRange"] == {"start": "2025-05-01", "end": "2025-05-05"}
    assert body["meta"]["surveyResponses"] == {"tripName": "Trip", "targetCount": 3}
    assert checks.document_problems(docs).count() == 0


def test_large_libraries_come_in_parts(spark, tmp_path):
    tables = document_tables(spark)
    assert documents.nested_documents(*tables, max_photos=4).count() == 0
    parts = documents.document_parts(*tables, rows_per_part=2)
    documents.write_documents(parts, str(tmp_path / "docs"))
    back = spark.read.json(str(tmp_path / "docs"))
    lists = [json.loads(r["body"]) for r in back.where("section = 'chapterPhotos'").orderBy("part").collect()]
    assert lists == [["p0", "p1"], ["p2", "p3"]]
    photos = [e["id"] for r in back.where("section = 'photos'").orderBy("part").collect() for e in json.loads(r["body"])]
    assert photos == [f"p{i}" for i in range(5)]


def test_document_in_lines_is_the_nested_one(spark):
    mapped, heads, placed, bursts, meta = document_tables(spark)
    more = spark.createDataFrame([("L", "p0", f"p{i}", i) for i in range(1, 4)] + [("L", "p2", "p3", 0)], bursts.schema)
    second = spark.createDataFrame([("L", 1, "chapter_002", None, None, None, None), ("L", 2, "chapter_003", "p9", "2025-06-01", None, None)], heads.schema)
    extra = placed.where("ordinal < 2").withColumns({"cluster_idx": F.lit(1), "chapter_id": F.lit("chapter_002")})
    tables = (mapped, heads.unionByName(second), placed.unionByName(extra), bursts.unionByName(more), meta)
    for given in (tables, (mapped, heads.limit(0), placed, bursts.limit(0), meta)):
        lines = documents.document_lines(*given, generated_at=F.lit(datetime(2025, 6, 1)), rows_per_part=2).orderBy("library_id", *documents.LINE_ORDER).cache()
        rows = lines.collect()
        body = documents.nested_documents(*given, generated_at=F.lit(datetime(2025, 6, 1))).first()["body"]
        assert json.loads("".join(r["text"] for r in rows)) == json.loads(body)
        # No line holds more than two entries of a list.
        assert max(r["text"].count('"qualityScore"') for r in rows) == 2
        want = {k: len(json.loads(body).get(k, [])) for k in ("photos", "chapters", "burstGroups")}
        got = {p: sum(r["entries"] for r in checks.read_lines(lines).collect() if r["place"] == p) for p in (documents.PHOTOS, documents.CHAPTERS, documents.BURSTS)}
        assert list(got.values()) == list(want.values())
        problems = {r["problem"] for r in checks.document_line_problems(lines).collect()}
        assert problems == {r["problem"] for r in checks.document_problems(spark.createDataFrame([("L", body)], "library_id string, body string")).collect()}
    broken = lines.withColumn("text", F.when(F.col("place") == documents.PHOTOS, F.concat("text", F.lit('"blob:'))).otherwise(F.col("text")))
    assert {"unreadable", "blob address"} <= {r["problem"] for r in checks.document_line_problems(broken).collect()}


def trip(spark, windows):
    return spark.createDataFrame([("L", i, f"e{i}", "2025-03-15", s, e) for i, (s, e) in enumerate(windows)],
                                 "library_id string, ord int, event_id string, date string, start_time string, end_time string")


def test_itinerary_ends_are_inclusive_and_first_event_wins(spark):
    times = ["08:00:00", "09:30:00", "09:30:00.5", "07:59:59.9", "10:00:00", "23:59:30", "23:59:00"]
    photos = spark.createDataFrame([("L", i, f"p{i}", datetime.fromisoformat(f"2025-03-15T{t}")) for i, t in enumerate(times)] +
                                   [("L", 9, "p9", None), ("M", 10, "p10", datetime(2025, 3, 15, 8))],
                                   "library_id string, ordinal int, photo_id string, ts timestamp")
    events = trip(spark, [("08:00", "09:30"), ("09:00", "10:00"), ("12:00", "11:00"), ("23:00", "23:59"), ("bad", "10:00"), ("08:00", "x")])
    got = {r["photo_id"]: r["event_id"] for r in itinerary.match_events(photos, events).collect()}
    assert got == {"p0": "e0", "p1": "e0", "p2": "e1", "p3": "other_moments", "p4": "e1", "p5": "other_moments", "p6": "e3",
                   "p9": "other_moments", "p10": "other_moments"}
    placed = itinerary.place_in_events(itinerary.match_events(photos, events))
    rows = {(r["library_id"], r["event_id"]): (r["photo_count"], r["hero_photo_id"]) for r in itinerary.event_chapters(placed, events).collect()}
    assert rows[("L", "e0")] == (2, "p1") and rows[("L", "e2")] == (0, None) and rows[("L", "other_moments")] == (3, "p5")


def test_itinerary_follows_the_zone(spark):
    photos = spark.createDataFrame([("L", 0, "p", datetime(2025, 3, 14, 23, 30))], "library_id string, ordinal int, photo_id string, ts timestamp")
    events = trip(spark, [("08:00", "09:00")])
    assert itinerary.match_events(photos, events, "Asia/Tokyo").first()["event_id"] == "e0"
    assert itinerary.match_events(photos, events, "UTC").first()["event_id"] == "other_moments"


def test_dates_are_utc_in_the_range(spark):
    mapped = spark.createDataFrame([("L", datetime(2025, 5, 1, 23, 59)), ("L", None)], "library_id string, ts timestamp")
    row = documents.date_range(mapped).first()
    assert row["start_date"] == row["end_date"] == date(2025, 5, 1)
