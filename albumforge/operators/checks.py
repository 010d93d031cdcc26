"""Checks of story documents, table by table. Every function returns the problems found, one per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumforge.operators.documents import BURSTS, CHAPTERS, HEAD, PHOTOS, TAIL, TO_BURSTS, TO_CHAPTERS


def problems(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows of (keys, problem) for each rule that holds; a rule that is null does not."""
    found = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda p: p.isNotNull())
    return df.select(*keys, F.explode(found).alias("problem"))


def photo_problems(photos: DataFrame, library_id: str = "library_id") -> DataFrame:
    """``photos`` has the entry ``key`` besides the photo's own columns; scores and flags may be missing."""
    has = lambda c: F.col(c).isNotNull()
    q = F.col("quality")
    return problems(photos, [library_id, "key"], {
        "id does not match key": ~F.col("photo_id").eqNullSafe(F.col("key")),
        "name missing": ~has("name"),
        "coords incomplete": has("lat") != has("lng"),
        "thumbnail is not a data URL": (F.col("thumbnail_url") != "") & ~F.startswith("thumbnail_url", F.lit("data:")),
        "failed flag missing": ~has("thumbnail_failed"),
        "quality outside 0-1": (q < 0) | (q > 1) | F.isnan(q),
        "file reference left": has("file"),
    })


def chapter_problems(chapters: DataFrame, chapter_photos: DataFrame, photos: DataFrame,
                     library_id: str = "library_id") -> DataFrame:
    """Empty chapters, unknown photos, a lead photo outside its chapter, half coordinates."""
    keys = [library_id, "chapter_id"]
    members = chapter_photos.select(*keys, "photo_id")
    unknown = members.join(photos.select(library_id, "photo_id"), [library_id, "photo_id"], "left_anti").select(
        *keys, F.concat(F.lit("unknown photo "), "photo_id").alias("problem"))
    stats = members.join(chapters.select(*keys, "hero_photo_id"), keys).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.max((F.col("photo_id") == F.col("hero_photo_id")).cast("int")).alias("_in"))
    own = problems(chapters.join(stats, keys, "left"), keys, {
        "no photos": F.col("_n").isNull(),
        "lead photo missing": F.col("hero_photo_id").isNull(),
        "lead photo not in chapter": F.col("hero_photo_id").isNotNull() & (F.coalesce("_in", F.lit(0)) == 0),
        "coords incomplete": F.col("lat").isNull() != F.col("lng").isNull(),
    })
    return own.unionByName(unknown)


def burst_problems(bursts: DataFrame, photos: DataFrame, library_id: str = "library_id") -> DataFrame:
    """``bursts`` has one row per (group_id, rep_id, candidate); a group without candidates has a null one."""
    keys = [library_id, "group_id"]
    known = photos.select(library_id, F.col("photo_id").alias("_id"))
    reps = bursts.select(*keys, F.col("rep_id").alias("_id")).distinct()
    candidates = bursts.where(F.col("photo_id").isNotNull()).select(*keys, F.col("photo_id").alias("_id"))
    say = lambda df, what: df.select(*keys, F.concat(F.lit(what + " "), "_id").alias("problem"))
    missing = lambda df: df.join(known, [library_id, "_id"], "left_anti")
    # Every mention of a photo, as representative or candidate; more than one is one too many.
    mentions = reps.unionByName(candidates)
    repeated = mentions.groupBy(library_id, "_id").agg(F.count("*").alias("_n"), F.min("group_id").alias("group_id")).where("_n > 1")
    empty = bursts.groupBy(*keys).agg(F.count("photo_id").alias("_n")).where("_n = 0").select(
        *keys, F.lit("no candidates").alias("problem"))
    own = bursts.where(F.col("photo_id") == F.col("rep_id")).select(
        *keys, F.concat(F.lit("candidate is the representative "), "photo_id").alias("problem"))
    parts = [say(missing(reps), "unknown representative"), say(missing(candidates), "unknown candidate"),
             say(repeated, "in more than one place"), empty, own]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def document_problems(docs: DataFrame, library_id: str = "library_id") -> DataFrame:
    """``docs`` holds each document as JSON text in ``body``: version, time, totals, no blob addresses."""
    field = lambda path: F.try_variant_get("_d", path, "variant")
    kind = lambda path: F.regexp_extract(F.schema_of_variant(field(path)), "^[A-Z]+", 0)
    numeric = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    not_kind = lambda path, *ok: ~F.coalesce(kind(path).isin(*ok), F.lit(False))
    read = docs.withColumn("_d", F.try_parse_json("body"))
    return problems(read, [library_id], {
        "version missing": not_kind("$.version", "STRING"),
        "generatedAt missing": not_kind("$.generatedAt", "STRING"),
        "photos missing": not_kind("$.photos", "OBJECT", "ARRAY"),
        "chapters missing": not_kind("$.chapters", "ARRAY"),
        "meta missing": not_kind("$.meta", "OBJECT", "ARRAY"),
        "totalPhotosInput not a number": ~not_kind("$.meta", "OBJECT", "ARRAY") & not_kind("$.meta.totalPhotosInput", *numeric),
        "totalChapters not a number": ~not_kind("$.meta", "OBJECT", "ARRAY") & not_kind("$.meta.totalChapters", *numeric),
        "blob address": F.contains(F.col("body"), F.lit("blob:")),
    })


def document_line_problems(lines: DataFrame, library_id: str = "library_id") -> DataFrame:
    """The same for documents in lines (``documents.document_lines``): their frames put together, and each line on its own."""
    read = read_lines(lines, library_id)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda r: r["text"])
    frames = lines.where(F.col("place").isin(HEAD, TO_CHAPTERS, TO_BURSTS, TAIL)).groupBy(library_id).agg(F.array_join(texts, "").alias("body"))
    own = read.groupBy(library_id).agg(F.bool_or(F.col("entries").isNull()).alias("_bad"), F.bool_or(F.contains("text", F.lit("blob:"))).alias("_blob"))
    inside = problems(own, [library_id], {"unreadable": F.col("_bad"), "blob address": F.col("_blob")})
    return document_problems(frames, library_id).unionByName(inside).distinct()


def read_lines(lines: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Lines that hold entries, each read by itself, with ``entries``: the photos in it, or the chapters or groups that begin in it; null where it can't be read."""
    bare = F.regexp_replace("text", "^,", "")
    list_name = F.when(F.col("place") == CHAPTERS, "photoIds").otherwise("candidateIds")
    whole = F.concat(F.when(F.col("first"), bare).otherwise(F.concat(F.lit('{"'), list_name, F.lit('":['), bare)),
                     F.when(F.col("last"), F.lit("")).otherwise(F.lit("]}")))
    # As text inside an array, nothing may follow the object.
    held = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), whole, F.lit("]"))), "$", "array<variant>")
    ids = F.try_variant_get(F.get(held, F.lit(0)), F.when(F.col("place") == CHAPTERS, "$.photoIds").otherwise("$.candidateIds"), "array<string>")
    listed = F.when((F.size(held) == 1) & ids.isNotNull(), F.col("first").cast("int"))
    photos = F.concat(F.lit("{"), bare, F.lit("}"))
    entries = F.when(F.col("place") == PHOTOS, F.when(F.try_parse_json(photos).isNotNull(), F.size(F.json_object_keys(photos)))).otherwise(listed)
    return lines.where(F.col("place").isin(PHOTOS, CHAPTERS, BURSTS)).select(library_id, "place", "text", entries.cast("bigint").alias("entries"))


def survey_check(surveys: DataFrame, default_target: int = 30) -> DataFrame:
    """``trip_name`` and ``target_text`` against ``photo_count``: trimmed name, whole target within range."""
    name = F.trim("trip_name")
    most = F.greatest(F.lit(1), F.coalesce("photo_count", F.lit(1)))
    digits = F.when(F.trim("target_text").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim("target_text"))
    number = digits.try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number)) & number.between(1, most)
    return surveys.select(
        "*", name.alias("clean_name"), (F.coalesce(name, F.lit("")) != "").alias("name_ok"),
        F.coalesce(whole, F.lit(False)).alias("target_ok"),
        F.when(whole, number.cast("bigint")).alias("target_count"),
        F.least(F.lit(default_target), most).cast("bigint").alias("default_target"))
