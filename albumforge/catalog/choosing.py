"""Quotas, starter sets, confusion histograms, scoring candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from albumforge.catalog import views
from albumforge.catalog.clustering import gap_placed
from albumforge.catalog.registry import query
from albumforge.operators import chapters as ch
from albumforge.operators import quota as q
from albumforge.operators import selection as sel


def quota_input(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of a source as its chapters, in alphabetical order."""
    w = Window.partitionBy("library_id").orderBy("chapter_id")
    return views.quota_chapters(spark, sf).withColumn("cluster_idx", F.row_number().over(w))


def targets_for(chapters: DataFrame, target) -> DataFrame:
    total = F.sum("photo_count") + 7
    return chapters.groupBy("library_id").agg(total.alias("total_photos"), target(total).cast("bigint").alias("target_count"))


def walk_sql(target: str) -> str:
    """The allocation unit by unit, by its own rules: floors, then passes in remainder order."""
    return f"""WITH RECURSIVE c AS (
  SELECT source AS library_id, lang AS chapter_id, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY lang) AS idx
  FROM documents GROUP BY 1, 2),
t AS (SELECT library_id, CAST(sum(n) + 7 AS BIGINT) AS total FROM c GROUP BY 1),
e AS (SELECT c.*, t.total, CAST(least({target}, total) AS BIGINT) AS cap,
             CAST(n AS DOUBLE) / total * CAST(least({target}, total) AS BIGINT) AS exact FROM c JOIN t USING (library_id)),
f AS (SELECT *, least(n, CAST(floor(exact) AS BIGINT)) AS base,
             row_number() OVER (PARTITION BY library_id ORDER BY exact - floor(exact) DESC, idx) AS turn FROM e),
u AS (SELECT library_id, chapter_id, idx, n, base, cap - sum(base) OVER (PARTITION BY library_id) AS spare,
             turn, unnest(generate_series(1, n - base)) AS pass FROM f WHERE n > base),
g AS (SELECT library_id, chapter_id, count(*) AS extra FROM (
        SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY pass, turn) AS place FROM u) WHERE place <= spare GROUP BY 1, 2)
SELECT f.library_id, f.chapter_id, f.base + coalesce(g.extra, 0) AS target
FROM f LEFT JOIN g ON g.library_id = f.library_id AND g.chapter_id = f.chapter_id"""


def allocated(spark: SparkSession, sf: str, target) -> DataFrame:
    chapters = quota_input(spark, sf)
    return q.allocate_targets(chapters, targets_for(chapters, target)).select("library_id", "chapter_id", "target")


@query("chapter_quotas", walk_sql("20"))
def chapter_quotas(spark: SparkSession, sf: str) -> DataFrame:
    return allocated(spark, sf, lambda total: F.lit(20))


@query("chapter_quotas_full", walk_sql("total"))
def chapter_quotas_full(spark: SparkSession, sf: str) -> DataFrame:
    """Target = total: the seven extra photos force several passes."""
    return allocated(spark, sf, lambda total: total)


V_TARGETS = views.V_CHAPTERS + """,
v_targets AS (SELECT *, CASE WHEN photo_count > 1 THEN CAST(ceil(photo_count / 2.0) AS BIGINT) ELSE 0 END AS target FROM v_chapters)"""


def with_half_target(chapters: DataFrame) -> DataFrame:
    n = F.col("photo_count")
    return chapters.withColumn("target", F.when(n > 1, F.ceil(n / 2)).otherwise(0).cast("bigint"))


@query("starter_set", f"""WITH {V_TARGETS},
r AS (SELECT p.library_id, p.photo_id, c.target, row_number() OVER (PARTITION BY p.library_id, p.cluster_idx
        ORDER BY CASE WHEN p.photo_id = c.hero_photo_id THEN 0 ELSE 1 END, coalesce(p.quality, -1) DESC, p.pos) AS pick
      FROM v_placed p JOIN v_targets c ON c.library_id = p.library_id AND c.cluster_idx = p.cluster_idx)
SELECT library_id, photo_id, pick - 1 AS pick FROM r WHERE pick <= target""")
def starter_set(spark: SparkSession, sf: str) -> DataFrame:
    placed = gap_placed(spark, sf)
    chapters = with_half_target(ch.select_heroes(placed))
    return q.starter_set(placed, chapters).select("library_id", "photo_id", "pick")


@query("fallback_starters", f"""WITH {views.V_CHAPTERS}
SELECT library_id, cluster_idx, hero_photo_id AS photo_id,
       CAST(least(8, greatest(1, floor(photo_count * 0.2e0 + 0.5e0))) AS BIGINT) AS target FROM v_chapters""")
def fallback_starters(spark: SparkSession, sf: str) -> DataFrame:
    from albumforge.functions.scores import fallback_target

    placed = gap_placed(spark, sf)
    chapters = ch.select_heroes(placed)
    picks = q.fallback_starters(placed, chapters)
    return picks.join(chapters, ["library_id", "cluster_idx"]).select(
        "library_id", "cluster_idx", "photo_id", fallback_target(F.col("photo_count")).alias("target"))


CELL = "CASE WHEN auto AND kept THEN 'tp' WHEN auto THEN 'fp' WHEN kept THEN 'fn' ELSE 'tn' END"


def marked(spark: SparkSession, sf: str) -> DataFrame:
    v = views.selection(spark, sf)
    return sel.mark_choices(v.drop("auto", "kept"), v.where("auto"), v.where("kept"))


@query("quality_histogram", f"""WITH {views.V_CONF},
b AS (SELECT library_id, quality, {CELL} AS cell, CASE WHEN quality IS NOT NULL THEN CAST(least(3, greatest(0, floor(quality * 4))) AS INT) END AS bucket FROM v_conf)
SELECT library_id, count(*) FILTER (quality IS NULL) AS null_quality,
       {', '.join(f"count(*) FILTER (cell = '{c}' AND bucket = {i}) AS {c}_q{i}" for c in sel.CELLS for i in range(4))}
FROM b GROUP BY 1""")
def quality_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return sel.quality_histogram(marked(spark, sf))


@query("confusion_cells", f"WITH {views.V_CONF} SELECT library_id, photo_id, {CELL} AS cell FROM v_conf")
def confusion_cells(spark: SparkSession, sf: str) -> DataFrame:
    return marked(spark, sf).select("library_id", "photo_id", sel.confusion_cell().alias("cell"))


@query("kept_intersection", f"WITH {views.V_CONF} SELECT library_id, photo_id FROM v_conf WHERE auto AND kept")
def kept_intersection(spark: SparkSession, sf: str) -> DataFrame:
    v = views.selection(spark, sf)
    ids = v.select("library_id", "photo_id")
    return ids.where(v["auto"]).intersect(ids.where(v["kept"]))


@query("merged_ids", f"WITH {views.V_CONF} SELECT library_id, photo_id FROM v_conf WHERE auto OR kept")
def merged_ids(spark: SparkSession, sf: str) -> DataFrame:
    v = views.selection(spark, sf)
    return sel.merged_ids(v.where("auto"), v.where("kept"))


@query("scoring_candidates", f"""WITH {views.V_GAPS},
r AS (SELECT library_id, cluster_idx, photo_id, row_number() OVER (PARTITION BY library_id, cluster_idx
        ORDER BY coalesce(quality, 0) DESC, pos) AS rk FROM v_placed WHERE ordinal % 6 > 0)
SELECT library_id, cluster_idx, photo_id FROM r WHERE rk <= 3""")
def scoring_candidates(spark: SparkSession, sf: str) -> DataFrame:
    placed = gap_placed(spark, sf).withColumn("variance", F.col("quality")).withColumn("has_file", F.col("ordinal") % 6 > 0)
    return sel.scoring_candidates(placed).select("library_id", "cluster_idx", "photo_id")


@query("kept_by_chapter", f"""WITH {views.V_CHAPTERS}
SELECT c.library_id, c.cluster_idx, count(p.photo_id) AS kept
FROM v_chapters c LEFT JOIN v_placed p ON p.library_id = c.library_id AND p.cluster_idx = c.cluster_idx AND p.ordinal % 3 = 0
GROUP BY 1, 2""")
def kept_by_chapter(spark: SparkSession, sf: str) -> DataFrame:
    placed = gap_placed(spark, sf)
    chapters = placed.select("library_id", "cluster_idx").distinct()
    return sel.kept_by_chapter(chapters, placed, placed.where("ordinal % 3 = 0")).select("library_id", "cluster_idx", "kept")


@query("curation_totals", f"""WITH {views.V_CONF},
t AS (SELECT source AS library_id, CAST(sum(CASE lang WHEN 'en' THEN 9 ELSE 4 END) AS BIGINT) AS total_target
      FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY 1),
k AS (SELECT library_id, count(*) FILTER (kept) AS total_kept, count(*) FILTER (auto) AS auto_kept FROM v_conf GROUP BY 1)
SELECT t.library_id, total_target, total_kept, auto_kept,
       CASE WHEN total_kept = 0 THEN 'empty' WHEN total_kept < total_target THEN 'under'
            WHEN total_kept <= ceil(total_target * 115 / 100.0) THEN 'on' ELSE 'over' END AS zone
FROM t JOIN k USING (library_id)""")
def curation_totals(spark: SparkSession, sf: str) -> DataFrame:
    v = views.selection(spark, sf)
    chapters = views.quota_chapters(spark, sf).withColumn("target", F.when(F.col("chapter_id") == "en", 9).otherwise(4))
    return sel.curation_totals(chapters, v.where("auto"), v.where("kept"))
