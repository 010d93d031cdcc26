"""The selection path end to end, and model scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.catalog import clustering, duplicates, similarity, views
from albumforge.catalog.clustering import gap_placed
from albumforge.catalog.registry import query
from albumforge.functions import models
from albumforge.functions import pixels as px
from albumforge.operators import selection as sel
from albumforge.operators import semantic as sm
from albumforge.operators.dedup import dedup
from albumforge.plans.selection import Selection, select_photos
from albumforge.session import cut_lineage

# Photos with picture hash, and time and place of the event with the same number.
V_KEPT = f"""v_photos AS (
  SELECT w.library_id, h.ordinal, w.photo_id, h.name, CASE WHEN e.event_type = 'error' THEN NULL ELSE e.ts END AS ts,
         CASE WHEN h.ordinal % 5 = 0 THEN NULL ELSE h.ordinal * 7919 % 90000 / 1000.0e0 END AS lat,
         CASE WHEN h.ordinal % 5 = 0 THEN NULL ELSE h.ordinal * 104729 % 180000 / 1000.0e0 END AS lng
  FROM v_walk w JOIN v_hash h ON h.photo_id = w.photo_id JOIN events e ON e.event_id = h.ordinal WHERE w.status = 'kept')"""
PATH_SQL = "WITH " + duplicates.WALK_SQL + ",\n" + views.V_CHAPTERS.replace(views.V_PHOTOS, V_KEPT)


def files(spark: SparkSession, sf: str) -> DataFrame:
    v = views.vectors(spark, sf)
    i = F.col("ordinal")
    e = views.events(spark, sf).select(
        F.col("event_id").alias("ordinal"), F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"))
    return cut_lineage(v.join(e, "ordinal").select(
        "library_id", "ordinal", "photo_id", "name", "ts", F.lit(None).cast("double").alias("quality"),
        F.when(i % 5 != 0, i * 7919 % 90000 / 1000.0).alias("lat"), F.when(i % 5 != 0, i * 104729 % 180000 / 1000.0).alias("lng"),
        i.alias("fingerprint"), F.when(i % 9 != 4, px.block_hash(F.col("blocks"))).alias("hash")))


def selected(spark: SparkSession, sf: str) -> Selection:
    return select_photos(files(spark, sf), "timeGap", stages={"dedup": lambda df: dedup(df, duplicates.THRESHOLD)})


@query("selected_chapters", PATH_SQL + """
SELECT library_id, chapter_id, photo_count, hero_photo_id, date, round(lat, 6) AS lat, round(lng, 6) AS lng FROM v_chapters""")
def selected_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return selected(spark, sf).chapters.select(
        "library_id", "chapter_id", "photo_count", "hero_photo_id", "date",
        F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("selected_photos", PATH_SQL + """
SELECT p.library_id, p.photo_id, 'selected' AS role FROM v_placed p
UNION ALL SELECT library_id, photo_id, 'burst-only' FROM v_walk WHERE status = 'burst'""")
def selected_photos(spark: SparkSession, sf: str) -> DataFrame:
    s = selected(spark, sf)
    return s.mapped.select(
        "library_id", "photo_id", F.when(F.col("status") == "kept", "selected").otherwise("burst-only").alias("role"))


# The same path with days, and with similarity from given starts, in place of gaps.
_PLACED = views.V_CHAPTERS[views.V_CHAPTERS.index("v_placed AS ("):]
DAY_PATH_SQL = f"""WITH {duplicates.WALK_SQL}, {V_KEPT}, {clustering.DAY_SQL.format(shift='')}, v_clustered AS (SELECT * FROM v_by_day),
{_PLACED}"""
SIMILAR_PATH_SQL = f"""WITH {duplicates.WALK_SQL}, {V_KEPT},
v_vec AS (SELECT p.library_id, p.photo_id, p.ordinal, e.blocks FROM v_photos p JOIN v_emb e ON e.photo_id = p.photo_id),
{similarity.kmeans_sql(similarity.GIVEN_ROUNDS, similarity.GIVEN_K)},
v_numbered AS (SELECT c.library_id, c.cluster, CAST(row_number() OVER (PARTITION BY c.library_id ORDER BY min(p.ts) NULLS LAST, c.cluster) - 1 AS INT) AS cluster_idx
  FROM v_c{similarity.GIVEN_ROUNDS} c JOIN v_photos p ON p.photo_id = c.photo_id GROUP BY 1, 2),
v_clustered AS (SELECT p.*, n.cluster_idx FROM v_photos p JOIN v_c{similarity.GIVEN_ROUNDS} c ON c.photo_id = p.photo_id
  JOIN v_numbered n ON n.library_id = c.library_id AND n.cluster = c.cluster),
{_PLACED}"""
CHAPTER_COLUMNS = """
SELECT library_id, chapter_id, photo_count, hero_photo_id, date, round(lat, 6) AS lat, round(lng, 6) AS lng FROM v_chapters"""


def chapter_rows(found: Selection) -> DataFrame:
    return found.chapters.select(
        "library_id", "chapter_id", "photo_count", "hero_photo_id", "date",
        F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("selected_chapters_by_day", DAY_PATH_SQL + CHAPTER_COLUMNS)
def selected_chapters_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return chapter_rows(select_photos(files(spark, sf), "day", stages={"dedup": lambda df: dedup(df, duplicates.THRESHOLD)}))


@query("selected_chapters_by_similarity", SIMILAR_PATH_SQL + CHAPTER_COLUMNS)
def selected_chapters_by_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Starts are the first photos kept, known after the first stage; so the step takes them from its own input."""
    vectors = views.vectors(spark, sf).select("photo_id", F.col("blocks").alias("embedding"))
    given = files(spark, sf).join(vectors, "photo_id")
    step = lambda kept: sm.semantic_clusters(kept, similarity.GIVEN_K, similarity.first_centroids(kept, similarity.GIVEN_K), max_rounds=similarity.GIVEN_ROUNDS)
    return chapter_rows(select_photos(given, "semantic", stages={"dedup": lambda df: dedup(df, duplicates.THRESHOLD), "cluster": step}))


def halves():
    """A model of two numbers: the sums of a vector's halves."""
    return lambda x: np.stack([x[:, :32].sum(axis=1), x[:, 32:].sum(axis=1)], axis=1)


@query("model_vectors", f"""WITH {views.V_EMB}
SELECT photo_id, round(list_sum(blocks[1:32]), 5) AS low, round(list_sum(blocks[33:64]), 5) AS high FROM v_emb""")
def model_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = views.vectors(spark, sf).select("photo_id", F.transform("blocks", lambda x: x.cast("double")).alias("x"))
    made = v.select("photo_id", models.model_vectors(halves, 2, F.col("x"), input_shapes=[[64]]).alias("v"))
    return made.select("photo_id", F.round(F.get("v", F.lit(0)), 5).alias("low"), F.round(F.get("v", F.lit(1)), 5).alias("high"))


def squash():
    return lambda x: 1 / (1 + np.exp(-x))


@query("model_scores", f"""WITH {views.V_GAPS},
r AS (SELECT *, row_number() OVER (PARTITION BY library_id, cluster_idx ORDER BY coalesce(quality, 0) DESC, pos) AS rk FROM v_placed)
SELECT library_id, photo_id, CASE WHEN rk <= 3 AND quality IS NOT NULL THEN round(1 / (1 + exp(-quality)), 6) END AS aesthetic_score FROM r""")
def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Only the three sharpest photos of a cluster reach the model."""
    placed = gap_placed(spark, sf).withColumns({"variance": F.col("quality"), "has_file": F.lit(True)})
    candidates = sel.scoring_candidates(placed).where("quality IS NOT NULL")
    scored = models.score_candidates(placed, candidates, squash, ["quality"])
    return scored.select("library_id", "photo_id", F.round("aesthetic_score", 6).alias("aesthetic_score"))
