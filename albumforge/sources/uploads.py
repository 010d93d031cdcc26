"""Uploaded image files and their metadata tags."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.operators.ordering import with_positions
from albumforge.session import shared_dir

# Accepted file types and upload limits.
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "heic", "heif", "webp", "tiff")
IMAGE_NAME = rf"(?i)\.({'|'.join(IMAGE_ENDINGS)})$"
MAX_FILE_BYTES = 50 * 1024 * 1024
# What opening a file counts as when files are dealt to tasks; with Spark's 4 MB a task gets some 30 files, however small.
OPEN_COST_BYTES = 64 * 1024
# The most that a task reads, opening included; folders that it lists; rows and bytes that a worker puts into a batch.
TASK_BYTES = 128 * 1024 * 1024
TASK_FOLDERS = 1_000
BATCH_ROWS = 10_000
BATCH_BYTES = 16 * 1024 * 1024
# The number of files an upload form takes at once; a caller may ask for it.
FORM_FILES = 500


def _arrow_store(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for ``path``, the full name of a folder, and the folder's name in it."""
    scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", path)
    if scheme is None or scheme[1] == "file":
        return fs.LocalFileSystem(), f"/{path[scheme.end() if scheme else 0:].strip('/')}"
    return fs.FileSystem.from_uri(path)


def write_files(contents: DataFrame, path: str) -> None:
    """One file under ``path`` for each row (``name``, which may hold folders, and ``content``), written by the tasks.

    Files go through Arrow's file systems, so ``path`` is the full name of a
    folder that every executor reaches. A row that is written again replaces its file.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _arrow_store(path)
        made = set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folder = f"{root}/{name}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_pydict({"files": [batch.num_rows]})

    contents.select("name", "content").mapInArrow(write, "files long").agg(F.sum("files")).collect()


def _plain_folder(spark: SparkSession, path: str) -> str | None:
    """The full name of ``path`` if it is one folder, in a store that Arrow opens."""
    if any(c in path for c in "{}[]*?\\"):
        return None
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = store.makeQualified(at).toString()
    try:
        own, root = _arrow_store(whole)
        return whole if own.get_file_info(root).type == fs.FileType.Directory else None
    except (pa.ArrowException, ImportError, OSError):
        return None


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """Image files under ``folder`` as a stored table (path, modificationTime, length); rows without a length are folders.

    Level by level, each folder by one task, which holds its entries. The driver
    sees how many folders a level has. What Spark's readers skip is skipped:
    hidden names and files without a byte.
    """
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _arrow_store(folder)
        root, base = root.rstrip("/"), folder.rstrip("/")
        for batch in batches:
            for parent in batch.column(0).to_pylist():
                rows = []
                for entry in store.get_file_info(fs.FileSelector(root + parent[len(base):], allow_not_found=True)):
                    name, inner = entry.base_name, entry.type == fs.FileType.Directory
                    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
                    if inner and (not hidden or name.startswith(("_metadata", "_common_metadata"))):
                        rows.append((f"{parent.rstrip('/')}/{name}", None, None))
                    elif entry.is_file and not hidden and entry.size and name.rpartition(".")[2].lower() in IMAGE_ENDINGS and "." in name:
                        rows.append((f"{parent.rstrip('/')}/{name}", entry.mtime_ns // 1_000_000 * 1_000, entry.size))
                for at in range(0, len(rows), BATCH_ROWS):
                    columns = zip(*rows[at:at + BATCH_ROWS], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "micros", "length"])

    table, levels = f"{shared_dir(spark)}/albumforge-listing-{uuid.uuid4().hex}", []
    read = lambda *paths: spark.read.schema("path string, modificationTime timestamp, length long").parquet(*paths)
    folders, n = spark.createDataFrame([(folder,)], "path string"), 1
    while n:
        tasks = min(n, max(spark.sparkContext.defaultParallelism, math.ceil(n / TASK_FOLDERS)))
        found = folders.repartition(tasks).mapInArrow(entries, "path string, micros long, length long")
        levels.append(f"{table}/{len(levels)}")
        found.select("path", F.timestamp_micros("micros").alias("modificationTime"), "length").write.parquet(levels[-1])
        folders = read(levels[-1]).where("length IS NULL").select("path")
        n = folders.count()
    return read(*levels)


def _content(folder: str) -> Column:
    """The bytes of the file named by ``path``, which lies under ``folder``; read one after the other, in batches of bounded size."""
    @F.arrow_udf("binary")
    def read(paths: Iterator[pa.Array]) -> Iterator[pa.Array]:
        store, root = _arrow_store(folder)
        root, base = root.rstrip("/"), folder.rstrip("/")
        for batch in paths:
            held, size = [], 0
            for path in batch.to_pylist():
                with store.open_input_stream(root + path[len(base):], compression=None) as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= BATCH_BYTES:
                    yield pa.array(held, pa.binary())
                    held, size = [], 0
            if held:
                yield pa.array(held, pa.binary())

    return read("path")


def list_images(spark: SparkSession, path: str, most_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Image files under ``path`` as (path, modificationTime, length, content).

    Other names are left out by the file listing, so they are never opened; the
    size limit reaches the reader, and content is read only if it is selected.
    Files without a byte are left out. The listing is made now, by tasks, and is a
    table in the shared folder: the driver never holds the names. Tasks get
    thousands of small files.

    A single file, a pattern, or a store that only Hadoop knows (s3a, viewfs) goes
    through Spark's own reader instead, with equal rows; its file index is held by the
    driver, some 500 bytes a file. That sets the session's open cost.
    """
    folder = _plain_folder(spark, path)
    if folder is None:
        spark.conf.set("spark.sql.files.openCostInBytes", str(OPEN_COST_BYTES))
        either = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ",".join(IMAGE_ENDINGS))
        return (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{either}}}").load(path)
            .where(F.col("length") <= most_bytes)
        )
    files = _listed(spark, folder).where(F.col("length") <= most_bytes)
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    cost = n * OPEN_COST_BYTES + size
    share = min(TASK_BYTES, max(OPEN_COST_BYTES, cost / spark.sparkContext.defaultParallelism))
    return files.repartition(max(1, math.ceil(cost / share))).withColumn("content", _content(folder))


def accept_uploads(listing: DataFrame, upload: str = "library_id", order: str = "ordinal",
                   name: str = "name", length: str = "length", most: int | None = None) -> DataFrame:
    """Every file with ``accepted`` and, where it is not, ``reject_reason``: 'type', 'size' or 'count'.

    ``most`` files of an upload are accepted, in input order, if the caller sets
    it; the places are counted over the rows of good files only.
    """
    fault = F.when(~F.coalesce(F.col(name).rlike(IMAGE_NAME), F.lit(False)), "type").when(
        ~F.coalesce(F.col(length) <= MAX_FILE_BYTES, F.lit(False)), "size")
    judged = listing.withColumn("reject_reason", fault)
    if most is not None:
        good = judged.where("reject_reason IS NULL").select(upload, order)
        placed = with_positions(good, [upload], [F.col(order).asc()], out="_no").where(F.col("_no") >= most)
        over = placed.select(F.col(upload).alias("_upload"), F.col(order).alias("_order"))
        judged = judged.join(over, (F.col(upload) == F.col("_upload")) & (F.col(order) == F.col("_order")), "left").withColumn(
            "reject_reason", F.coalesce("reject_reason", F.when(F.col("_order").isNotNull(), "count"))).drop("_upload", "_order")
    return judged.withColumn("accepted", F.col("reject_reason").isNull())


def _first_set(*names: str) -> Column:
    """First tag that is set; a size of 0 counts as missing."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit(0)) for n in names])


def normalise_tags(tags: DataFrame) -> DataFrame:
    """Photo metadata from raw tags: time, size and position, each from its first usable tag."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return (
        tags.withColumn("ts", F.coalesce("date_time_original", "create_date", "modify_date"))
        .withColumn("width", _first_set("image_width", "exif_image_width", "pixel_x_dimension"))
        .withColumn("height", _first_set("image_height", "exif_image_height", "pixel_y_dimension"))
        .withColumn("lat", F.when(located, F.col("latitude")))
        .withColumn("lng", F.when(located, F.col("longitude")))
    )


# Columns a photo row always has; missing ones become null.
OPTIONAL_COLUMNS = {
    "make": "string", "model": "string", "lens_model": "string", "iso": "int", "f_number": "double",
    "exposure_time": "double", "orientation": "string", "thumbnail_url": "string",
    "thumbnail_hero_url": "string", "quality": "double",
}


def photo_rows(tags: DataFrame) -> DataFrame:
    """Photo table: ids from the input order, absent tags as null, empty result columns."""
    rows = normalise_tags(tags)
    for name, kind in OPTIONAL_COLUMNS.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.select(
        "library_id", "ordinal",
        F.concat(F.lit("photo_"), F.col("ordinal").cast("string")).alias("photo_id"),
        "name", "size", "ts", "lat", "lng", "width", "height", *OPTIONAL_COLUMNS,
        F.lit(False).alias("thumbnail_failed"),
    )


def upload_metadata(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Stored files with the time from their tags (null when there are none)."""
    times = tags.select("library_id", "ordinal",
                        F.coalesce("date_time_original", "create_date", "modify_date").alias("timestamp"))
    return files.join(times, ["library_id", "ordinal"], "left").select(
        "library_id", "ordinal", "filename", "original_name", "file_path", "timestamp")
