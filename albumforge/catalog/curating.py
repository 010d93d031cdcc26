"""Keep/remove presses, curated chapters, side strip, session ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.catalog import views
from albumforge.catalog.clustering import gap_placed
from albumforge.catalog.registry import query
from albumforge.operators import chapters as ch
from albumforge.operators import curation as cu
from albumforge.operators import strip as sp


def starters(spark: SparkSession, sf: str) -> DataFrame:
    """Photo 1 of every even conversation is in the starter set."""
    return views.actions(spark, sf).where("library_id % 2 = 0").select(
        "library_id", F.lit(1).cast("bigint").alias("photo_id")).distinct()


@query("replayed_choices", f"""WITH RECURSIVE {views.V_ACTIONS},
s AS (SELECT DISTINCT library_id, 1 AS photo_id FROM v_actions WHERE library_id % 2 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY library_id, photo_id ORDER BY seq) AS n FROM v_actions),
w AS (
  SELECT o.library_id, o.photo_id, n, CASE action WHEN 'on' THEN TRUE WHEN 'off' THEN FALSE ELSE s.photo_id IS NULL END AS kept
  FROM o LEFT JOIN s ON s.library_id = o.library_id AND s.photo_id = o.photo_id WHERE n = 1
  UNION ALL
  SELECT o.library_id, o.photo_id, o.n, CASE o.action WHEN 'on' THEN TRUE WHEN 'off' THEN FALSE ELSE NOT w.kept END
  FROM w JOIN o ON o.library_id = w.library_id AND o.photo_id = w.photo_id AND o.n = w.n + 1),
f AS (SELECT library_id, photo_id, max(n) AS presses, arg_max(kept, n) AS kept FROM w GROUP BY 1, 2)
SELECT coalesce(f.library_id, s.library_id) AS library_id, coalesce(f.photo_id, s.photo_id) AS photo_id,
       coalesce(f.kept, TRUE) AS kept, f.presses IS NOT NULL AS touched, coalesce(f.presses, 0) AS presses
FROM f FULL JOIN s ON s.library_id = f.library_id AND s.photo_id = f.photo_id""")
def replayed_choices(spark: SparkSession, sf: str) -> DataFrame:
    return cu.replay(views.actions(spark, sf), starters(spark, sf))


@query("session_counts", f"""WITH {views.V_ACTIONS},
l AS (SELECT library_id, max(seq) FILTER (action = 'off') AS off FROM v_actions GROUP BY 1)
SELECT a.library_id, count(*) AS presses, count(DISTINCT photo_id) AS distinct_photos,
       count(*) FILTER (off IS NULL OR seq > off) AS streak
FROM v_actions a JOIN l ON a.library_id = l.library_id GROUP BY 1""")
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    return cu.session_counts(views.actions(spark, sf))


@query("streaks", f"""WITH {views.V_ACTIONS},
p AS (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY seq) - 1 AS pos FROM v_actions)
SELECT library_id, seq, pos - coalesce(max(CASE WHEN action = 'off' THEN pos END) OVER (PARTITION BY library_id ORDER BY seq), -1) AS streak FROM p""")
def streaks(spark: SparkSession, sf: str) -> DataFrame:
    return cu.streaks(views.actions(spark, sf)).select("library_id", "seq", "streak")


@query("curated_chapters", f"""WITH {views.V_CHAPTERS},
k AS (SELECT * FROM v_placed WHERE ordinal % 3 = 0)
SELECT c.library_id, c.cluster_idx, count(*) AS photo_count,
       coalesce(max(CASE WHEN k.photo_id = c.hero_photo_id THEN k.photo_id END), arg_min(k.photo_id, k.pos)) AS hero_photo_id
FROM v_chapters c JOIN k ON k.library_id = c.library_id AND k.cluster_idx = c.cluster_idx GROUP BY 1, 2""")
def curated_chapters(spark: SparkSession, sf: str) -> DataFrame:
    placed = gap_placed(spark, sf)
    chapters = ch.select_heroes(placed)
    return cu.curated_chapters(chapters, placed, placed.where("ordinal % 3 = 0")).select(
        "library_id", "cluster_idx", "photo_count", "hero_photo_id")


@query("pruned_originals", f"WITH {views.V_PHOTOS} SELECT library_id, photo_id FROM v_photos WHERE ordinal % 3 = 0 AND ordinal % 2 = 0")
def pruned_originals(spark: SparkSession, sf: str) -> DataFrame:
    p = views.photos(spark, sf).select("library_id", "photo_id", "ordinal")
    return cu.curated_photos(p.where("ordinal % 2 = 0"), p.where("ordinal % 3 = 0")).select("library_id", "photo_id")


@query("strip_marks", f"""WITH {views.V_GAPS},
b AS (SELECT *, CASE WHEN ordinal % 10 < 5 THEN concat('b', ordinal % 2) END AS burst FROM v_placed),
s AS (SELECT *, lag((epoch_us(ts) // 1000)) OVER w AS pm, lag(burst) OVER w AS pb, lead(burst) OVER w AS nb, lag(pos) OVER w AS pp, lead(pos) OVER w AS np
      FROM b WINDOW w AS (PARTITION BY library_id, cluster_idx ORDER BY pos)),
g AS (SELECT *, CASE WHEN pm IS NULL OR ts IS NULL THEN 0.0e0 ELSE abs((epoch_us(ts) // 1000) - pm) / 60000.0e0 END AS gap FROM s)
SELECT library_id, photo_id, coalesce(strftime(ts, '%H:%M'), '') AS clock, round(gap, 6) AS gap_minutes, gap >= 20 AS gap_mark,
       CASE WHEN gap >= 20 THEN concat(CAST(floor(gap + 0.5) AS BIGINT), 'm') END AS gap_text,
       burst IS NOT NULL AND burst IS DISTINCT FROM pb AS burst_start, burst IS NOT NULL AND burst IS DISTINCT FROM nb AS burst_end,
       coalesce((epoch_us(ts) // 1000), 0) AS epoch_ms
FROM g""")
def strip_marks(spark: SparkSession, sf: str) -> DataFrame:
    placed = gap_placed(spark, sf)
    i = F.col("ordinal")
    bursts = placed.where(i % 10 < 5).select("library_id", "photo_id", F.concat(F.lit("b"), (i % 2).cast("string")).alias("burst"))
    # A small block, so that rows at block edges are exercised.
    marks = sp.strip_marks(placed, bursts, block=16)
    return marks.select("library_id", "photo_id", "clock", F.round("gap_minutes", 6).alias("gap_minutes"), "gap_mark",
                        "gap_text", "burst_start", "burst_end", "epoch_ms")


@query("gap_texts", """WITH g AS (SELECT o_orderkey AS k, (o_orderkey * 7 % 30000) / 10.0e0 AS m FROM orders)
SELECT k, CASE WHEN m > 90 THEN concat(replace(CAST(floor(m / 60 * 10 + 0.5) / 10 AS VARCHAR), '.0', ''), 'h')
               ELSE concat(CAST(floor(m + 0.5) AS BIGINT), 'm') END AS gap_text FROM g""")
def gap_texts(spark: SparkSession, sf: str) -> DataFrame:
    from albumforge.functions.text import gap_text

    k = F.col("o_orderkey")
    return views.table(spark, sf, "orders").select(k.alias("k"), gap_text(k * 7 % 30000 / 10.0).alias("gap_text"))


def session_events(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    e = views.telemetry(spark, sf)
    return e.where(F.col("event_name") == kind).select("session_id", F.col("event_id").alias("seq"), "k")


@query("first_completions", f"""WITH {views.V_TELEMETRY}
SELECT session_id, min(event_id) AS seq, arg_min(k, event_id) AS k FROM v_telemetry WHERE event_name = 'purchase' GROUP BY 1""")
def first_completions(spark: SparkSession, sf: str) -> DataFrame:
    return cu.first_completions(session_events(spark, sf, "purchase"))


@query("bail_outs", f"""WITH {views.V_TELEMETRY},
f AS (SELECT session_id, min(event_id) AS done FROM v_telemetry WHERE event_name = 'purchase' GROUP BY 1)
SELECT e.session_id, e.event_id AS seq, CASE WHEN k % 2 = 0 THEN 'back' ELSE 'tab_close' END AS kind
FROM v_telemetry e LEFT JOIN f ON e.session_id = f.session_id
WHERE event_name = 'error' AND (k % 2 = 0 OR done IS NULL OR done > event_id)""")
def bail_outs(spark: SparkSession, sf: str) -> DataFrame:
    leaves = session_events(spark, sf, "error").withColumn("kind", F.when(F.col("k") % 2 == 0, "back").otherwise("tab_close"))
    return cu.bail_outs(leaves, session_events(spark, sf, "purchase")).select("session_id", "seq", "kind")
