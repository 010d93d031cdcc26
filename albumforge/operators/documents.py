"""Story documents and export lists.

A document is kept as tables (photos, chapters, chapter photos, bursts, meta). As
JSON it is written in parts of bounded size, so a library of any size can be
written. A library can also come as one nested document, which is one value and
so bounded by what a row may hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.functions import text as tx
from albumforge.functions.scores import display_orientation
from albumforge.operators.curation import kept_in_time_order
from albumforge.operators.ordering import with_positions
from albumforge.session import store

VERSION = "1.0"
ROWS_PER_PART = 1000


def photo_map(photos: DataFrame, chapter_photos: DataFrame, bursts: DataFrame,
              library_id: str = "library_id") -> DataFrame:
    """Photos a document holds: those shown, and burst candidates of a shown photo."""
    keys = [library_id, "photo_id"]
    # Semi joins only: a photo that is named twice is held once all the same.
    shown = chapter_photos.select(*keys)
    candidates = bursts.join(shown.withColumnRenamed("photo_id", "rep_id"), [library_id, "rep_id"], "left_semi").select(*keys)
    return photos.join(shown.unionByName(candidates), keys, "left_semi")


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def photo_entries(photos: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Photo columns as a document holds them: no file reference, defaults for what is missing."""
    width, height = _column(photos, "width", "int"), _column(photos, "height", "int")
    located = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return photos.select(
        library_id, "ordinal", F.col("photo_id").alias("id"), "name",
        F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("ts").cast("timestamp_ntz")),
                      "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.when(located, F.struct("lat", "lng")).alias("coords"),
        width.alias("width"), height.alias("height"),
        display_orientation(_column(photos, "orientation", "string"), width, height).alias("orientation"),
        F.nullif(_column(photos, "thumbnail_url", "string"), F.lit("")).alias("thumbnailUrl"),
        F.nullif(_column(photos, "thumbnail_hero_url", "string"), F.lit("")).alias("thumbnailHeroUrl"),
        F.coalesce(_column(photos, "thumbnail_failed", "boolean"), F.lit(False)).alias("thumbnailFailed"),
        F.col("quality").alias("qualityScore"))


def date_range(mapped: DataFrame, library_id: str = "library_id") -> DataFrame:
    """First and last UTC date over all photos of the document, burst candidates included."""
    utc = F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("ts").cast("timestamp_ntz")))
    return mapped.groupBy(library_id).agg(F.min(utc).alias("start_date"), F.max(utc).alias("end_date"))


def document_meta(uploaded: DataFrame, kept: DataFrame, mapped: DataFrame, chapters: DataFrame,
                  surveys: DataFrame | None = None, library_id: str = "library_id") -> DataFrame:
    """Totals and date range per library; survey answers when given (trip_name, target_count)."""
    count = lambda df, name: df.groupBy(library_id).agg(F.count("*").alias(name))
    out = count(uploaded, "total_photos_input").join(count(kept, "total_photos_after_dedup"), library_id, "left").join(
        count(chapters, "total_chapters"), library_id, "left").join(date_range(mapped, library_id), library_id, "left")
    out = out.fillna(0, ["total_photos_after_dedup", "total_chapters"])
    return out if surveys is None else out.join(surveys.select(library_id, "trip_name", "target_count"), library_id, "left")


def _ordered(order: str, *columns: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("_v"))))
    return F.transform(rows, lambda r: r["_v"])


ENTRY = ("id", "name", "timestamp", "coords", "width", "height", "orientation", "thumbnailUrl", "thumbnailHeroUrl",
         "thumbnailFailed", "qualityScore")


def document_parts(mapped: DataFrame, chapters: DataFrame, chapter_photos: DataFrame, burst_rows: DataFrame,
                   meta: DataFrame, library_id: str = "library_id", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(library, section, owner, part, body): JSON arrays of at most ``rows_per_part`` entries.

    ``owner`` is the chapter or the burst representative the entries belong to.
    ``burst_rows`` has ``candidate_no``. Putting the parts of a section together
    in order gives the document's section.
    """
    part = lambda pos: F.floor(F.col(pos) / rows_per_part)
    none = F.lit("").alias("owner")
    entries = with_positions(photo_entries(mapped, library_id), [library_id], [F.col("ordinal").asc()], out="_at")
    photos = entries.groupBy(library_id, part("_at").alias("part")).agg(F.to_json(_ordered("_at", *ENTRY)).alias("body"))
    photos = photos.select(library_id, F.lit("photos").alias("section"), none, "part", "body")
    lists = chapter_photos.groupBy(library_id, F.col("chapter_id").alias("owner"), part("pos").alias("part")).agg(
        F.to_json(F.transform(_ordered("pos", "photo_id"), lambda r: r["photo_id"])).alias("body"))
    lists = lists.select(library_id, F.lit("chapterPhotos").alias("section"), "owner", "part", "body")
    bursts = burst_rows.groupBy(library_id, F.col("rep_id").alias("owner"), part("candidate_no").alias("part")).agg(
        F.to_json(F.transform(_ordered("candidate_no", "photo_id"), lambda r: r["photo_id"])).alias("body"))
    bursts = bursts.select(library_id, F.lit("burstGroups").alias("section"), "owner", "part", "body")
    heads = chapters.select(library_id, F.lit("chapter").alias("section"), F.col("chapter_id").alias("owner"),
                            F.lit(0).cast("bigint").alias("part"), F.to_json(_chapter()).alias("body"))
    totals = meta.select(library_id, F.lit("meta").alias("section"), none, F.lit(0).cast("bigint").alias("part"),
                         F.to_json(_meta(meta)).alias("body"))
    return photos.unionByName(lists).unionByName(bursts).unionByName(heads).unionByName(totals)


def _chapter() -> Column:
    return F.struct(F.col("chapter_id").alias("id"), F.col("hero_photo_id").alias("heroPhotoId"), "date",
                    F.when(F.col("lat").isNotNull(), F.struct("lat", "lng")).alias("coords"))


def _meta(meta: DataFrame) -> Column:
    span = F.when(F.col("start_date").isNotNull(), F.struct(
        F.date_format("start_date", "yyyy-MM-dd").alias("start"), F.date_format("end_date", "yyyy-MM-dd").alias("end")))
    survey = F.struct(_column(meta, "trip_name", "string").alias("tripName"),
                      _column(meta, "target_count", "bigint").alias("targetCount"))
    return F.struct(
        F.col("total_photos_input").alias("totalPhotosInput"), F.col("total_photos_after_dedup").alias("totalPhotosAfterDedup"),
        F.col("total_chapters").alias("totalChapters"), span.alias("dateRange"), survey.alias("surveyResponses"))


def nested_documents(mapped: DataFrame, chapters: DataFrame, chapter_photos: DataFrame, burst_rows: DataFrame,
                     meta: DataFrame, generated_at: Column | None = None, library_id: str = "library_id",
                     max_photos: int | None = None) -> DataFrame:
    """One JSON document per library, of every library unless the caller sets ``max_photos``.

    The whole document is one row; ``document_parts`` and ``document_lines`` are
    the forms for libraries of any size.
    """
    only = lambda df: df
    if max_photos is not None:
        small = mapped.groupBy(library_id).agg(F.count("*").alias("_n")).where(F.col("_n") <= max_photos).select(library_id)
        only = lambda df: df.join(small, library_id, "left_semi")
    when = F.current_timestamp() if generated_at is None else generated_at
    entries = only(photo_entries(mapped, library_id)).groupBy(library_id).agg(
        F.map_from_entries(F.collect_list(F.struct("id", F.struct(*ENTRY)))).alias("photos"))
    listed = only(chapter_photos).groupBy(library_id, "chapter_id").agg(
        F.transform(_ordered("pos", "photo_id"), lambda r: r["photo_id"]).alias("photo_ids"))
    chaps = only(chapters).join(listed, [library_id, "chapter_id"]).groupBy(library_id).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cluster_idx", F.struct(
            F.col("chapter_id").alias("id"), F.col("photo_ids").alias("photoIds"),
            F.col("hero_photo_id").alias("heroPhotoId"), "date",
            F.when(F.col("lat").isNotNull(), F.struct("lat", "lng")).alias("coords")).alias("c")))),
            lambda r: r["c"]).alias("chapters"))
    groups = only(burst_rows).groupBy(library_id, F.col("rep_id").alias("representativeId")).agg(
        F.transform(_ordered("candidate_no", "photo_id"), lambda r: r["photo_id"]).alias("candidateIds"))
    bursts = groups.groupBy(library_id).agg(
        F.array_sort(F.collect_list(F.struct("representativeId", "candidateIds"))).alias("burstGroups"))
    joined = only(meta).select(library_id, _meta(meta).alias("meta")).join(entries, library_id).join(
        chaps, library_id, "left").join(bursts, library_id, "left")
    empty = F.array().cast("array<struct<representativeId:string,candidateIds:array<string>>>")
    stamp = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return joined.select(library_id, F.to_json(F.struct(
        F.lit(VERSION).alias("version"), stamp.alias("generatedAt"), "photos", "chapters",
        F.coalesce("burstGroups", empty).alias("burstGroups"), "meta")).alias("body"))


# Where the lines of a nested document stand: its frame, and what fills it.
HEAD, PHOTOS, TO_CHAPTERS, CHAPTERS, TO_BURSTS, BURSTS, TAIL = range(7)
LINE_ORDER = ("place", "no", "owner", "part")


def _inside(body: Column) -> Column:
    """JSON text without its outer brackets."""
    return F.substring(body, F.lit(2), F.length(body) - 2)


def _behind(first: Column, text: Column) -> Column:
    return F.concat(F.when(first, F.lit("")).otherwise(F.lit(",")), text)


def _list_lines(rows: DataFrame, place: int, no: Column, owner: Column, pos: str, opening: Column, closing: Column, library_id: str, rows_per_part: int) -> DataFrame:
    """Objects that end with a list of photo ids, cut into lines; ``opening`` and ``closing`` are the text around the list."""
    keyed = rows.select(library_id, no.cast("bigint").alias("no"), owner.alias("owner"), F.col(pos).alias("_pos"), "photo_id",
                        F.floor(F.col(pos) / rows_per_part).alias("part"), opening.alias("_open"), closing.alias("_close"))
    lines = keyed.groupBy(library_id, "no", "owner", "part").agg(
        F.first("_open").alias("_open"), F.first("_close").alias("_close"),
        _inside(F.to_json(F.transform(_ordered("_pos", "photo_id"), lambda r: r["photo_id"]))).alias("_ids"))
    ends = lines.groupBy(library_id, "no", "owner").agg(F.min("part").alias("_first"), F.max("part").alias("_last"))
    front = ends.groupBy(library_id).agg(F.min(F.struct("no", "owner")).alias("_front"))
    first, last = F.col("part") == F.col("_first"), F.col("part") == F.col("_last")
    own = F.struct("no", "owner") == F.col("_front")
    return lines.join(ends, [library_id, "no", "owner"]).join(front, library_id).select(
        library_id, F.lit(place).alias("place"), "no", "owner", "part", first.alias("first"), last.alias("last"),
        F.concat(F.when(first, _behind(own, F.col("_open"))).otherwise(F.lit(",")), F.col("_ids"), F.when(last, F.col("_close")).otherwise(F.lit(""))).alias("text"))


def document_lines(mapped: DataFrame, chapters: DataFrame, chapter_photos: DataFrame, burst_rows: DataFrame, meta: DataFrame,
                   generated_at: Column | None = None, library_id: str = "library_id", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """The nested documents as text in lines of at most ``rows_per_part`` entries, so of libraries of any size.

    Lines of a library put together in ``LINE_ORDER`` are its document. A line
    holds whole entries of one list; ``first`` and ``last`` say whether the chapter
    or burst group it belongs to begins and ends in it.
    """
    keys = [library_id, "chapter_id"]
    entries = with_positions(photo_entries(mapped, library_id), [library_id], [F.col("ordinal").asc()], out="_at")
    maps = entries.groupBy(library_id, F.floor(F.col("_at") / rows_per_part).alias("part")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("id", F.struct(*ENTRY))))).alias("_map"))
    plain = lambda place, part, first, text: [F.lit(place).alias("place"), F.lit(0).cast("bigint").alias("no"), F.lit("").alias("owner"), part.alias("part"),
                                              F.lit(True).alias("first"), F.lit(True).alias("last"), _behind(first, text).alias("text")]
    photos = maps.select(library_id, *plain(PHOTOS, F.col("part"), F.col("part") == 0, _inside(F.col("_map"))))
    rest = F.to_json(F.struct(F.col("hero_photo_id").alias("heroPhotoId"), "date", F.when(F.col("lat").isNotNull(), F.struct("lat", "lng")).alias("coords")))
    heads = chapters.select(*keys, F.col("cluster_idx").alias("_idx"), F.concat(
        F.lit("]"), F.when(rest == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.substring(rest, F.lit(2), F.length(rest))))).alias("_rest"))
    opened = lambda name, c, ids: F.concat(F.regexp_replace(F.to_json(F.struct(F.col(c).alias(name))), r"\}$", ","), F.lit(f'"{ids}":['))
    listed = chapter_photos.select(*keys, "pos", "photo_id").join(heads, keys)
    chaps = _list_lines(listed, CHAPTERS, F.col("_idx"), F.col("chapter_id"), "pos", opened("id", "chapter_id", "photoIds"), F.col("_rest"), library_id, rows_per_part)
    bursts = _list_lines(burst_rows, BURSTS, F.lit(0), F.col("rep_id"), "candidate_no", opened("representativeId", "rep_id", "candidateIds"), F.lit("]}"), library_id, rows_per_part)
    stamp = F.date_format(F.current_timestamp() if generated_at is None else generated_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    start = F.to_json(F.struct(F.lit(VERSION).alias("version"), stamp.alias("generatedAt")))
    told = chapter_photos.join(chapters.select(*keys), keys, "left_semi").select(library_id).distinct().withColumn("_told", F.lit(True))
    framed = meta.select(library_id, start.alias("_start"), F.to_json(_meta(meta)).alias("_meta")).join(
        mapped.select(library_id).distinct(), library_id, "left_semi").join(told, library_id, "left")
    has = F.coalesce("_told", F.lit(False))
    frame = ((HEAD, F.concat(F.regexp_replace("_start", r"\}$", ""), F.lit(',"photos":{'))),
             (TO_CHAPTERS, F.when(has, F.lit('},"chapters":[')).otherwise(F.lit("}"))),
             (TO_BURSTS, F.when(has, F.lit('],"burstGroups":[')).otherwise(F.lit(',"burstGroups":['))),
             (TAIL, F.concat(F.lit('],"meta":'), F.col("_meta"), F.lit("}"))))
    zero = F.lit(0).cast("bigint")
    out = framed.select(library_id, F.explode(F.array(*[F.struct(F.lit(place).alias("place"), text.alias("text")) for place, text in frame])).alias("_f")).select(
        library_id, "_f.place", zero.alias("no"), F.lit("").alias("owner"), zero.alias("part"), F.lit(True).alias("first"), F.lit(True).alias("last"), "_f.text")
    known = framed.select(library_id)
    for lines in (photos, chaps, bursts):
        out = out.unionByName(lines.join(known, library_id, "left_semi"))
    return out


def write_documents(documents: DataFrame, path: str, library_id: str = "library_id") -> None:
    """JSON lines, libraries kept together and large ones spread over files."""
    order = [c for c in (library_id, "section", "owner", "part") if c in documents.columns]
    documents.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def downloadable(photos: DataFrame, originals: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Photos that have an original or any thumbnail; adds ``original_name``."""
    names = originals.select(library_id, "photo_id", "original_name")
    usable = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return photos.join(names, [library_id, "photo_id"], "left").where(
        F.col("original_name").isNotNull() | usable("thumbnail_hero_url") | usable("thumbnail_url"))


def export_manifest(kept_photos: DataFrame, originals: DataFrame, library_id: str = "library_id") -> DataFrame:
    """File name and source of every exported photo, numbered in time order over the exported ones only."""
    placed = kept_in_time_order(downloadable(kept_photos, originals, library_id), library_id)
    original = F.col("original_name").isNotNull()
    name = F.nullif("name", F.lit(""))
    base = tx.clean_base(F.when(original, F.coalesce(name, F.col("original_name"))).otherwise(F.col("name")))
    suffix = F.when(original, tx.extension(F.col("original_name"))).otherwise(F.lit(".jpg"))
    source = (
        F.when(original, F.lit("original"))
        .when(F.coalesce(F.col("thumbnail_hero_url"), F.lit("")) != "", F.lit("hero_thumbnail")).otherwise(F.lit("thumbnail")))
    return placed.select(
        library_id, "photo_id", (F.col("kept_no") + 1).alias("number"),
        F.concat(tx.padded(F.col("kept_no") + 1, 2), F.lit("-"), base, suffix).alias("file_name"), source.alias("source"))


def story_rows(placed: DataFrame, event_chapters: DataFrame, trips: DataFrame, library_id: str = "library_id") -> DataFrame:
    """The itinerary story, flat: trip name, chapter columns and one row per photo (one without for empty chapters)."""
    photos = placed.select(library_id, "event_id", "photo_id", "pos")
    return event_chapters.join(trips.select(library_id, "trip_name"), library_id, "left").join(
        photos, [library_id, "event_id"], "left")


def replace_documents(documents: DataFrame, path: str, library_id: str = "library_id") -> None:
    """Document parts under ``path``, by library; only the libraries in ``documents`` are replaced.

    Each library is a partition of the table, so writing it again, or running a
    job again that was lost, leaves one copy; other libraries' files are not
    touched. Parts of a large library are spread over files. Finding the ranges
    reads the parts once more, so they are stored first and not made twice.
    """
    order = [c for c in ("section", "owner", "part") if c in documents.columns]
    laid = store(documents).repartitionByRange(library_id, *order).sortWithinPartitions(library_id, *order)
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(library_id).parquet(path)


def read_documents(spark: SparkSession, path: str, *sections: str) -> DataFrame:
    """Parts of the given sections; files hold sections in order, so others are skipped."""
    parts = spark.read.parquet(path)
    return parts.where(F.col("section").isin(*sections)) if sections else parts
