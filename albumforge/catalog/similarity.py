"""Vectors: attaching, normalising, k-means steps, cluster order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumforge.catalog import views
from albumforge.catalog.registry import query
from albumforge.functions.pixels import unit_vector
from albumforge.operators import semantic as sm
from albumforge.operators import snapshots as sn
from albumforge.session import cut_lineage
from albumforge.sources.scored import attach_scores, attach_vectors


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    return views.vectors(spark, sf).withColumnRenamed("blocks", "embedding")


def photos_with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Photos of the event table; the first ones have a vector."""
    v = views.table(spark, sf, "embeddings").select(
        F.concat(F.lit("photo_"), F.col("vec_id").cast("string")).alias("photo_id"), "embedding")
    return attach_vectors(views.photos(spark, sf), v, keys=["photo_id"])


@query("attached_vectors", f"""WITH {views.V_PHOTOS}
SELECT p.photo_id, e.vec_id IS NOT NULL AS embedded, round(e.embedding[1]::DOUBLE, 6) AS first_value
FROM v_photos p LEFT JOIN embeddings e ON e.vec_id = p.ordinal""")
def attached_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return photos_with_vectors(spark, sf).select(
        "photo_id", F.col("embedding").isNotNull().alias("embedded"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value"))


@query("vector_snapshot", f"""WITH {views.V_PHOTOS}
SELECT library_id, count(e.vec_id) AS embedded, count(*) - count(e.vec_id) AS without
FROM v_photos p LEFT JOIN embeddings e ON e.vec_id = p.ordinal GROUP BY 1""")
def vector_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return sn.vector_snapshot(photos_with_vectors(spark, sf))


@query("attached_scores", f"""WITH {views.V_PHOTOS}
SELECT library_id, photo_id, CASE WHEN ordinal % 6 = 0 THEN quality END AS aesthetic_score,
       CASE WHEN ordinal % 6 = 0 THEN ordinal % 4 = 0 END AS aesthetic_keep,
       CASE WHEN ordinal % 6 = 0 THEN CASE WHEN ordinal % 5 = 0 THEN 'sharp' ELSE '' END END AS aesthetic_reason FROM v_photos""")
def attached_scores(spark: SparkSession, sf: str) -> DataFrame:
    p, i = views.photos(spark, sf), F.col("ordinal")
    scores = p.where(i % 2 == 0).select("library_id", "photo_id", F.col("quality").alias("score"), (i % 4 == 0).alias("keep"),
                                        F.when(i % 5 == 0, "sharp").alias("reason"))
    return attach_scores(p, scores, p.where(i % 3 == 0)).select(
        "library_id", "photo_id", "aesthetic_score", "aesthetic_keep", "aesthetic_reason")


@query("unit_vectors", f"""WITH {views.V_EMB},
x AS (SELECT photo_id, list_transform(blocks, lambda v, i: v * i) AS b FROM v_emb),
n AS (SELECT photo_id, b, sqrt(list_sum(list_transform(b, lambda v: v * v))) AS norm FROM x)
SELECT photo_id, CAST(unnest(range(64)) AS INT) AS dim, round(unnest(b) / norm, 6) AS value FROM n""")
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    stretched = F.transform("embedding", lambda v, i: v.cast("double") * (i + 1))
    return embedded(spark, sf).select("photo_id", F.posexplode(unit_vector(stretched)).alias("dim", "v")).select(
        "photo_id", "dim", F.round("v", 6).alias("value"))


def first_centroids(v: DataFrame, k: int = 6) -> DataFrame:
    """The first ``k`` vectors of each library as start."""
    from pyspark.sql import Window

    w = Window.partitionBy("library_id").orderBy("ordinal")
    top = v.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return top.groupBy("library_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rn", "embedding"))),
        lambda s: F.transform(s["embedding"], lambda x: x.cast("double"))).alias("centroids"))


V_ASSIGN = views.V_EMB + """,
v_start AS (SELECT library_id, rn - 1 AS c, blocks FROM (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY ordinal) AS rn FROM v_emb) WHERE rn <= 6),
v_sims AS (SELECT e.library_id, e.photo_id, s.c, list_sum(list_transform(list_zip(e.blocks, s.blocks), lambda z: z[1] * z[2])) AS sim
           FROM v_emb e JOIN v_start s ON s.library_id = e.library_id),
v_assign AS (SELECT library_id, photo_id, CAST(c AS INT) AS cluster FROM (
  SELECT *, row_number() OVER (PARTITION BY library_id, photo_id ORDER BY sim DESC, c) AS rn FROM v_sims) WHERE rn = 1)"""


@query("nearest_centroids", f"WITH {V_ASSIGN} SELECT library_id, photo_id, cluster FROM v_assign")
def nearest_centroids(spark: SparkSession, sf: str) -> DataFrame:
    v = embedded(spark, sf)
    return sm.assign(v, first_centroids(v)).select("library_id", "photo_id", "cluster")


@query("updated_centroids", f"""WITH {V_ASSIGN},
d AS (SELECT a.library_id, a.cluster, e.photo_id, unnest(range(64)) AS dim, unnest(e.blocks) AS x FROM v_assign a JOIN v_emb e ON e.photo_id = a.photo_id),
m AS (SELECT library_id, cluster, dim, avg(x) AS mean FROM d GROUP BY 1, 2, 3)
SELECT library_id, cluster, CAST(dim AS INT) AS dim, round(mean / sqrt(sum(mean * mean) OVER (PARTITION BY library_id, cluster)), 6) AS value FROM m""")
def updated_centroids(spark: SparkSession, sf: str) -> DataFrame:
    v = embedded(spark, sf)
    moved = sm.update(sm.assign(v, first_centroids(v)))
    return moved.select("library_id", "cluster", F.posexplode("centroid").alias("dim", "v")).select(
        "library_id", "cluster", "dim", F.round("v", 6).alias("value"))


@query("default_cluster_counts", """SELECT label AS library_id, count(*) AS n, CAST(greatest(2, least(12, floor(count(*) / 8.0e0 + 0.5e0))) AS INT) AS k FROM embeddings GROUP BY 1""")
def default_cluster_counts(spark: SparkSession, sf: str) -> DataFrame:
    return embedded(spark, sf).groupBy("library_id").agg(F.count("*").alias("n")).withColumn("k", sm.default_k(F.col("n")))


def kmeans_sql(rounds: int, k: int = 6) -> str:
    """v_c{rounds}: library, photo and cluster of the rows of v_vec (library_id, photo_id, ordinal, blocks), from the first ``k`` of each library as start."""
    steps = [f"v_m0 AS (SELECT library_id, rn - 1 AS c, blocks FROM (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY ordinal) AS rn FROM v_vec) WHERE rn <= {k})"]
    for r in range(1, rounds + 1):
        steps.append(f"""v_c{r} AS (SELECT library_id, photo_id, CAST(c AS INT) AS cluster FROM (
  SELECT e.library_id, e.photo_id, m.c, row_number() OVER (PARTITION BY e.library_id, e.photo_id ORDER BY list_inner_product(e.blocks, m.blocks) DESC, m.c) AS rn
  FROM v_vec e JOIN v_m{r - 1} m ON m.library_id = e.library_id) WHERE rn = 1),
v_s{r} AS (SELECT a.library_id, a.cluster, i, avg(e.blocks[i]) AS x FROM v_c{r} a JOIN v_vec e ON e.library_id = a.library_id AND e.photo_id = a.photo_id, range(1, 65) d(i) GROUP BY ALL),
v_m{r} AS (SELECT library_id, cluster AS c, list(x / n ORDER BY i) AS blocks FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY library_id, cluster)) AS n FROM v_s{r}) GROUP BY 1, 2)""")
    return ",\n".join(steps)


# Rounds from given starts, and clusters of each library then.
GIVEN_ROUNDS, GIVEN_K = 6, 6


@query("semantic_clusters", f"""WITH {views.V_EMB}, v_vec AS (SELECT * FROM v_emb),
{kmeans_sql(GIVEN_ROUNDS, GIVEN_K)},
g AS (SELECT library_id, cluster, row_number() OVER (PARTITION BY library_id ORDER BY cluster) - 1 AS cluster_idx FROM (SELECT DISTINCT library_id, cluster FROM v_c{GIVEN_ROUNDS}))
SELECT c.library_id, c.photo_id, CAST(g.cluster_idx AS INT) AS cluster_idx, row_number() OVER (PARTITION BY c.library_id, c.cluster ORDER BY v.ordinal) - 1 AS pos,
       count(*) OVER (PARTITION BY c.library_id, c.cluster) AS cluster_size
FROM v_c{GIVEN_ROUNDS} c JOIN g ON g.library_id = c.library_id AND g.cluster = c.cluster JOIN v_vec v ON v.photo_id = c.photo_id""")
def semantic_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """From given start points, so that SQL can follow; drawn ones: see settled_clusters."""
    v = embedded(spark, sf).withColumn("ts", F.lit(None).cast("timestamp"))
    found = sm.semantic_clusters(v, GIVEN_K, first_centroids(v, GIVEN_K), max_rounds=GIVEN_ROUNDS)
    return sm.place_semantic(found).select("library_id", "photo_id", "cluster_idx", "pos", "cluster_size")


@query("settled_clusters", f"""WITH {views.V_EMB}, v_vec AS (SELECT * FROM v_emb),
{kmeans_sql(1, 12)},
n AS (SELECT library_id, count(*) AS photos, CAST(greatest(2, least(12, floor(count(*) / 8.0e0 + 0.5e0))) AS INT) AS k FROM v_vec GROUP BY 1),
o AS (SELECT library_id, avg(best) AS cosine FROM (SELECT e.library_id, e.photo_id, max(list_inner_product(e.blocks, m.blocks)) AS best
  FROM v_vec e JOIN v_m0 m ON m.library_id = e.library_id JOIN n ON n.library_id = e.library_id WHERE m.c < n.k GROUP BY 1, 2) GROUP BY 1)
SELECT n.library_id, n.photos, 0 AS misplaced, k AS clusters, o.cosine > 0 AS closer, TRUE AS settled FROM n JOIN o ON o.library_id = n.library_id""")
def settled_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """What holds whatever the start points: no vector is nearer to another cluster's mean than to its own, every cluster
    has members, and vectors are closer to their means than to the first k vectors of their library."""
    v = embedded(spark, sf)
    found = cut_lineage(sm.kmeans(v.select("library_id", "photo_id", "ordinal", "embedding"), max_rounds=None))
    means = sm.update(found).groupBy("library_id").agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("c"))
    own = found.withColumnRenamed("cluster", "own")
    # Numbers of clusters are dense, so a place in the array is the number.
    centroids = cut_lineage(means.select("library_id", F.transform("c", lambda x: x["centroid"]).alias("centroids")))
    best = lambda sims: sims.max(axis=1)
    again = sm.against_centroids(own, centroids, sm._nearest, {"cluster": "centroids"})
    near = sm.against_centroids(again, centroids, best, {"cosine": "centroids"})
    sizes = v.groupBy("library_id").agg(F.count("*").alias("n")).withColumn("k", sm.default_k(F.col("n")))
    starts = first_centroids(v, sm.MOST_CLUSTERS).join(sizes, "library_id").select("library_id", F.slice("centroids", F.lit(1), F.col("k")).alias("centroids"))
    near = sm.against_centroids(near, cut_lineage(starts), best, {"before": "centroids"})
    return near.groupBy("library_id").agg(
        F.count("*").alias("photos"), F.count_if(F.col("cluster").cast("int") != F.col("own")).cast("int").alias("misplaced"),
        F.countDistinct("own").cast("int").alias("clusters"), (F.avg("cosine") > F.avg("before")).alias("closer"), F.bool_and("settled").alias("settled"))


@query("ordered_clusters", f"""WITH {views.V_PHOTOS},
c AS (SELECT *, CASE WHEN ordinal % 7 > 0 THEN ordinal % 6 END AS cluster FROM v_photos),
g AS (SELECT library_id, cluster, row_number() OVER (PARTITION BY library_id ORDER BY cluster IS NULL, min(ts) NULLS LAST, cluster) - 1 AS idx FROM c GROUP BY 1, 2)
SELECT c.library_id, c.photo_id, CAST(g.idx AS INT) AS cluster_idx FROM c JOIN g ON g.library_id = c.library_id AND g.cluster IS NOT DISTINCT FROM c.cluster""")
def ordered_clusters(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("ordinal")
    given = views.photos(spark, sf).withColumn("cluster", F.when(i % 7 > 0, (i % 6).cast("int")))
    return sm.order_clusters(given).select("library_id", "photo_id", "cluster_idx")


@query("semantic_positions", f"""WITH {views.V_PHOTOS}
SELECT p.photo_id, row_number() OVER (PARTITION BY p.library_id, ordinal % 6 ORDER BY CASE WHEN e.vec_id IS NOT NULL THEN ts END NULLS LAST, ordinal) - 1 AS pos
FROM v_photos p LEFT JOIN embeddings e ON e.vec_id = p.ordinal""")
def semantic_positions(spark: SparkSession, sf: str) -> DataFrame:
    """By time with undated last; photos without a vector keep their input order."""
    given = photos_with_vectors(spark, sf).withColumn("cluster_idx", (F.col("ordinal") % 6).cast("int"))
    return sm.place_semantic(given).select("photo_id", "pos")
