"""Fingerprints, exact copies, near duplicates and bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.catalog import views
from albumforge.catalog.registry import query
from albumforge.functions import pixels as px
from albumforge.operators import dedup as dd
from albumforge.session import cut_lineage

THRESHOLD = 24  # hashes of random vectors are never within the default 10

FP_SQL = """v_fp AS (
  SELECT source AS library_id, doc_id AS ordinal, concat('doc_', CAST(doc_id AS VARCHAR)) AS photo_id,
         text AS fp
  FROM documents)"""


def fingerprinted(spark: SparkSession, sf: str) -> DataFrame:
    """Written once, so that the content is read a single time."""
    return cut_lineage(views.doc_files(spark, sf).select(
        "library_id", "ordinal", "photo_id", dd.fingerprint(F.col("content")).alias("fingerprint")))


@query("fingerprint_groups", f"""WITH {FP_SQL}
SELECT min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal, count(*) AS copies FROM v_fp GROUP BY fp""")
def fingerprint_groups(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprinted(spark, sf).groupBy("fingerprint").agg(
        F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"),
        F.count("*").alias("copies")).drop("fingerprint")


@query("exact_duplicates", f"""WITH {FP_SQL}
SELECT library_id, photo_id, CASE WHEN ordinal = f THEN 'kept' ELSE 'exact' END AS status,
       CASE WHEN ordinal <> f THEN f END AS first_ordinal
FROM (SELECT *, min(ordinal) OVER (PARTITION BY library_id, fp) AS f FROM v_fp)""")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return dd.exact_duplicates(fingerprinted(spark, sf)).select("library_id", "photo_id", "status", "first_ordinal")


@query("exact_duplicates_overall", f"""WITH {FP_SQL}
SELECT photo_id, CASE WHEN ordinal = f THEN 'kept' ELSE 'exact' END AS status
FROM (SELECT *, min(ordinal) OVER (PARTITION BY fp) AS f FROM v_fp)""")
def exact_duplicates_overall(spark: SparkSession, sf: str) -> DataFrame:
    return dd.exact_duplicates(fingerprinted(spark, sf), keys=()).select("photo_id", "status")


def hashed(spark: SparkSession, sf: str) -> DataFrame:
    """Every ninth picture could not be read and has no hash. Written once: the walk samples its input first."""
    v = views.vectors(spark, sf)
    return cut_lineage(v.select("library_id", "ordinal", "photo_id", "name",
                                F.when(F.col("ordinal") % 9 != 4, px.block_hash(F.col("blocks"))).alias("hash")))


@query("block_hashes", f"""WITH {views.V_HASH}
SELECT photo_id, CAST(h & 4294967295 AS BIGINT) AS low_bits, CAST(h >> 32 AS BIGINT) AS high_bits FROM v_hash""")
def block_hashes(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("h")
    return views.vectors(spark, sf).select("photo_id", px.block_hash(F.col("blocks")).alias("h")).select(
        "photo_id", h.bitwiseAND(F.lit(4294967295)).alias("low_bits"),
        F.shiftrightunsigned(h, 32).alias("high_bits"))


GRID_SQL = f"""v_grid AS (
  SELECT photo_id, list_transform(range(1024), lambda i: floor(128 + 300 * blocks[(i // 32) // 4 * 8 + (i % 32) // 4 + 1] + i % 7 + 0.5)) AS gray
  FROM ({{}}))"""


def gray_grid(blocks):
    """A 32 x 32 gray grid grown from 64 values, with some texture added."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(1023)),
        lambda i: F.floor(128 + 300 * F.get(blocks, (F.floor(F.floor(i / 32) / 4) * 8 + F.floor(i % 32 / 4)).cast("int")).cast("double")
                          + i % 7 + 0.5))


@query("block_means", f"""WITH {views.V_EMB}, {GRID_SQL.format('SELECT * FROM v_emb')},
b AS (SELECT photo_id, gray, unnest(range(64)) AS block FROM v_grid)
SELECT photo_id, CAST(block AS INT) AS block,
       list_sum(list_transform(range(16), lambda c: gray[(block // 8 * 4 + c // 4) * 32 + block % 8 * 4 + c % 4 + 1])) / 16 AS mean
FROM b""")
def block_means(spark: SparkSession, sf: str) -> DataFrame:
    gray = gray_grid(F.col("blocks"))
    return views.vectors(spark, sf).select("photo_id", gray.alias("gray")).select(
        "photo_id", F.posexplode(px.block_means(F.col("gray"))).alias("block", "mean"))


@query("block_hash_vectorised", f"""WITH {views.V_EMB}, {GRID_SQL.format('SELECT * FROM v_emb')},
m AS (SELECT photo_id, list_transform(range(64), lambda b: list_sum(list_transform(range(16), lambda c:
        gray[(b // 8 * 4 + c // 4) * 32 + b % 8 * 4 + c % 4 + 1])) / 16) AS means FROM v_grid),
w AS (SELECT *, (list_sort(means)[32] + list_sort(means)[33]) / 2 AS middle FROM m)
SELECT photo_id, CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN means[i + 1] > middle THEN 1 ELSE 0 END)) AS BIGINT) AS bits_on,
       CAST(list_sum(list_transform(range(32), lambda i: CASE WHEN means[i + 1] > middle THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT) AS low_bits
FROM w""")
def block_hash_vectorised(spark: SparkSession, sf: str) -> DataFrame:
    gray = F.transform(gray_grid(F.col("blocks")), lambda x: x.cast("double"))
    return views.vectors(spark, sf).select("photo_id", px.block_hash_np(gray).alias("h")).select(
        "photo_id", F.bit_count("h").cast("bigint").alias("bits_on"),
        F.col("h").bitwiseAND(F.lit(4294967295)).alias("low_bits"))


@query("gray_levels", """WITH p AS (
  SELECT vec_id, unnest(range(64)) AS cell, embedding FROM embeddings)
SELECT vec_id, CAST(cell AS INT) AS cell,
       CAST(floor(0.299e0 * floor(abs(embedding[cell + 1]::DOUBLE) * 255) + 0.587e0 * ((cell * 5 + vec_id) % 256)
                  + 0.114e0 * (cell * 3 % 256) + 0.5e0) AS INT) AS gray
FROM p""")
def gray_levels(spark: SparkSession, sf: str) -> DataFrame:
    v = views.table(spark, sf, "embeddings")
    cells = F.sequence(F.lit(0), F.lit(63))
    red = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 255))
    green = F.transform(cells, lambda i: (i * 5 + F.col("vec_id")) % 256)
    blue = F.transform(cells, lambda i: i * 3 % 256)
    return v.select("vec_id", F.posexplode(px.gray_levels(red, green, blue)).alias("cell", "gray"))


@query("hamming_to_previous", f"""WITH {views.V_HASH}
SELECT photo_id, CAST(bit_count(xor(h, lag(h) OVER (PARTITION BY library_id ORDER BY ordinal))) AS INT) AS distance FROM v_hash""")
def hamming_to_previous(spark: SparkSession, sf: str) -> DataFrame:
    from albumforge.operators.ordering import neighbours, with_positions

    v = views.vectors(spark, sf).select("library_id", "ordinal", "photo_id", px.block_hash(F.col("blocks")).alias("hash"))
    placed = with_positions(v, ["library_id"], [F.col("ordinal").asc()])
    return neighbours(placed, ["library_id"], before={"previous": "hash"}).select(
        "photo_id", px.hamming(F.col("hash"), F.col("previous")).alias("distance"))


WALK_SQL = f"""RECURSIVE {views.V_HASH},
v_seq AS (SELECT library_id, photo_id, CASE WHEN ordinal % 9 <> 4 THEN h END AS h,
                 row_number() OVER (PARTITION BY library_id ORDER BY ordinal) AS n FROM v_hash),
v_walk AS (
  SELECT library_id, n, photo_id, 'kept' AS status, CAST(NULL AS VARCHAR) AS rep_id, CAST(NULL AS INT) AS distance,
         CAST(NULL AS INT) AS nearest_distance, [{{'h': h, 'id': photo_id}}] AS recent
  FROM v_seq WHERE n = 1
  UNION ALL
  SELECT library_id, n, photo_id, CASE WHEN hit THEN 'burst' ELSE 'kept' END,
         CASE WHEN hit THEN best.id END, CASE WHEN hit THEN best.d END, CASE WHEN NOT hit THEN best.d END,
         CASE WHEN hit THEN recent ELSE list_prepend({{'h': h, 'id': photo_id}}, recent)[1:5] END
  FROM (SELECT *, coalesce(best.d <= {THRESHOLD}, FALSE) AS hit FROM (
    SELECT s.library_id, s.n, s.photo_id, s.h, w.recent,
           CASE WHEN s.h IS NOT NULL THEN list_sort(list_filter(list_transform(w.recent,
             lambda x, i: {{'d': CAST(bit_count(xor(x.h, s.h)) AS INT), 'i': i, 'id': x.id}}), lambda x: x.d IS NOT NULL))[1] END AS best
    FROM v_walk w JOIN v_seq s ON s.library_id = w.library_id AND s.n = w.n + 1)))"""


@query("near_duplicates", f"""WITH {WALK_SQL}
SELECT library_id, photo_id, status, rep_id, distance, nearest_distance FROM v_walk""")
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return dd.near_duplicates(hashed(spark, sf), THRESHOLD).select(
        "library_id", "photo_id", "status", "rep_id", "distance", "nearest_distance")


@query("burst_members", f"""WITH {WALK_SQL}
SELECT library_id, rep_id, photo_id, row_number() OVER (PARTITION BY library_id, rep_id ORDER BY n) - 1 AS candidate_no,
       count(*) OVER (PARTITION BY library_id, rep_id) AS candidates
FROM v_walk WHERE status = 'burst'""")
def burst_members(spark: SparkSession, sf: str) -> DataFrame:
    return dd.burst_members(dd.near_duplicates(hashed(spark, sf), THRESHOLD)).select(
        "library_id", "rep_id", "photo_id", "candidate_no", "candidates")


@query("burst_ids", f"""WITH {WALK_SQL},
g AS (SELECT library_id, rep_id, concat('b', row_number() OVER (PARTITION BY library_id ORDER BY min(n)) - 1) AS burst
      FROM v_walk WHERE status = 'burst' GROUP BY library_id, rep_id)
SELECT v.library_id, v.photo_id, g.burst
FROM v_walk v LEFT JOIN g ON g.library_id = v.library_id AND g.rep_id = coalesce(v.rep_id, v.photo_id)""")
def burst_ids(spark: SparkSession, sf: str) -> DataFrame:
    marked = dd.near_duplicates(hashed(spark, sf), THRESHOLD)
    return marked.select("library_id", "photo_id").join(
        dd.burst_ids(marked), ["library_id", "photo_id"], "left")


@query("dedup_both_passes", f"""WITH RECURSIVE {views.V_HASH},
v_first AS (SELECT *, min(ordinal) OVER (PARTITION BY library_id, ordinal % 150) AS f FROM v_hash),
v_seq AS (SELECT library_id, photo_id, h, row_number() OVER (PARTITION BY library_id ORDER BY ordinal) AS n
          FROM v_first WHERE ordinal = f),
{WALK_SQL[WALK_SQL.index('v_walk AS ('):]}
SELECT library_id, photo_id, status, rep_id FROM v_walk
UNION ALL SELECT library_id, photo_id, 'exact', NULL FROM v_first WHERE ordinal <> f""")
def dedup_both_passes(spark: SparkSession, sf: str) -> DataFrame:
    v = views.vectors(spark, sf)
    files = v.select("library_id", "ordinal", "photo_id", "name", px.block_hash(F.col("blocks")).alias("hash"),
                     (F.col("ordinal") % 150).alias("fingerprint"))
    return dd.dedup(files, THRESHOLD).select("library_id", "photo_id", "status", "rep_id")
