"""Clusters by visual similarity: cosine k-means inside every library at once.

A photo never fans out over its centroids: they are broadcast when all of them
together are small, and otherwise come as one array column by a one-to-one join.
Assignment is vectorised in Arrow batches; the update is Spark's own vector
summariser, which combines before its shuffle.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from albumforge.functions.pixels import unit_vector
from albumforge.functions.scores import half_up
from albumforge.operators.ordering import with_positions
from albumforge.session import cut_lineage, shared_dir

MAX_ROUNDS = 50
# Fixed value: the most clusters that a library gets by default.
MOST_CLUSTERS = 12
BROADCAST_BYTES = 64 * 1024 * 1024


def _nearest(sims: np.ndarray) -> np.ndarray:
    """Index of the highest similarity per row; the first wins ties."""
    return np.argmax(sims, axis=1).astype(np.float64)


def _seed_weight(sims: np.ndarray) -> np.ndarray:
    """Squared cosine distance to the closest centroid."""
    return (1 - sims.max(axis=1)) ** 2


def _matrix(rows) -> np.ndarray:
    return np.stack([np.asarray(r, dtype=np.float64) for r in rows])


def centroids_fit(centroids: DataFrame, columns=("centroids",)) -> bool:
    """Whether the centroids of all libraries together may be broadcast."""
    numbers = [F.coalesce(F.size(c) * F.size(F.element_at(c, 1)), F.lit(0)) for c in columns]
    total = centroids.agg(*[F.sum(n) for n in numbers]).first()
    return sum(n or 0 for n in total) * 8 <= BROADCAST_BYTES


def against_centroids(vectors: DataFrame, centroids: DataFrame, measure: Callable, outputs: dict[str, str],
                      library_id: str = "library_id", small: bool | None = None) -> DataFrame:
    """Keep vectors of libraries that have centroids and measure their similarities to them.

    ``outputs`` maps new columns to columns of ``centroids``. Centroids of all
    libraries together are usually a few megabytes; then (``small``, checked
    here unless given) they are broadcast once and a batch is one matrix product
    per library. Otherwise each row gets its library's centroids by a join. A
    library whose centroids are null counts as 0.
    """
    columns = list(outputs.values())
    if small if small is not None else centroids_fit(centroids, columns):
        known = {r[0]: [None if c is None else _matrix(c) for c in r[1:]]
                 for r in centroids.select(library_id, *columns).collect()}
        shared = vectors.sparkSession.sparkContext.broadcast(known)

        def measured(which: int):
            @F.pandas_udf(T.DoubleType())
            def by_library(libraries: pd.Series, rows: pd.Series) -> pd.Series:
                result = np.zeros(len(rows))
                for lib, at in libraries.groupby(libraries).indices.items():
                    if shared.value[lib][which] is not None:
                        result[at] = measure(_matrix(rows.iloc[at]) @ shared.value[lib][which].T)
                return pd.Series(result)

            return by_library(library_id, "embedding")

        present = vectors.join(F.broadcast(centroids.select(library_id)), library_id, "left_semi")
        return present.select("*", *[measured(i).alias(out) for i, out in enumerate(outputs)])

    @F.pandas_udf(T.DoubleType())
    def by_row(rows: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([0.0 if c is None else float(measure(np.asarray(v, dtype=np.float64)[None, :] @ _matrix(c).T)[0])
                          for v, c in zip(rows, found)])

    joined = vectors.join(centroids.select(library_id, *[F.col(c).alias(f"_at_{c}") for c in columns]), library_id)
    return joined.select("*", *[by_row("embedding", f"_at_{c}").alias(out) for out, c in outputs.items()]).drop(
        *[f"_at_{c}" for c in columns])


def default_k(n: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(MOST_CLUSTERS), half_up(n / 8))).cast("int")


def assign(vectors: DataFrame, centroids: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Add ``cluster``, the centroid with the highest dot product. ``centroids`` has an array of vectors per library."""
    found = against_centroids(vectors, centroids, _nearest, {"cluster": "centroids"}, library_id)
    return found.withColumn("cluster", F.col("cluster").cast("int"))


def update(assigned: DataFrame, library_id: str = "library_id") -> DataFrame:
    """New centroid per (library, cluster): the normalised mean of its members."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding"))))
    means = assigned.groupBy(library_id, "cluster").agg(mean.alias("_mean"))
    return means.select(library_id, "cluster", unit_vector(F.col("_mean")).alias("centroid"))


def _u01(*cols) -> Column:
    """A repeatable number in (0, 1) from the given columns."""
    return (F.pmod(F.xxhash64(*cols), F.lit(2**53 - 1)) + 1) / F.lit(float(2**53))


def seed_centroids(vectors: DataFrame, sizes: DataFrame, seed: int = 0, library_id: str = "library_id",
                   small: bool | None = None, rounds: int = 2, over: int = 2) -> DataFrame:
    """Start centroids by oversampling: ``rounds`` times, ``over`` * k more vectors of each library are drawn at once.

    A vector is drawn with weight (1 - cosine)^2 to those chosen so far: the
    top ones by log(u)/weight, with u from a hash of the row, which Spark limits per
    library before the shuffle. Each vector then counts for its nearest candidate,
    and a weighted k-means++ among the few candidates of a library leaves k.
    The number of passes over the vectors doesn't grow with k.
    """
    draw = F.struct(_u01(F.lit(seed), F.lit(0), "ordinal"), "ordinal")
    first = vectors.groupBy(library_id).agg(F.max_by("embedding", draw).alias("_v")).join(
        sizes.select(library_id, "k"), library_id)
    doubles = lambda c: F.transform(c, lambda x: x.cast("double"))
    chosen = cut_lineage(first.select(library_id, "k", F.array(doubles("_v")).alias("centroids")))
    most = chosen.agg(F.max("k")).first()[0] or 0
    for step in range(1, rounds + 1):
        weighed = against_centroids(vectors, chosen, _seed_weight, {"_w": "centroids"}, library_id, small).where("_w > 0")
        # log(u)/w orders like u^(1/w).
        key = F.log(_u01(F.lit(seed), F.lit(step), "ordinal")) / F.col("_w")
        best = Window.partitionBy(library_id).orderBy(key.desc(), "ordinal")
        top = weighed.withColumn("_no", F.row_number().over(best)).where(F.col("_no") <= over * most)
        fresh = top.join(F.broadcast(chosen.select(library_id, "k")) if small else chosen.select(library_id, "k"), library_id).where(F.col("_no") <= over * F.col("k"))
        drawn = fresh.groupBy(library_id).agg(F.array_sort(F.collect_list(F.struct("_no", doubles("embedding").alias("v")))).alias("_new"))
        more = F.coalesce(F.transform("_new", lambda r: r["v"]), F.array().cast("array<array<double>>"))
        chosen = cut_lineage(chosen.join(drawn, library_id, "left").select(library_id, "k", F.concat("centroids", more).alias("centroids")))
    near = against_centroids(vectors, chosen, _nearest, {"_c": "centroids"}, library_id, small)
    counted = near.groupBy(library_id, F.col("_c").cast("int").alias("_c")).agg(F.count("*").alias("n"))
    weights = counted.groupBy(library_id).agg(F.map_from_entries(F.collect_list(F.struct("_c", "n"))).alias("_n"))
    rows = chosen.join(weights, library_id).withColumn(
        "_n", F.transform("centroids", lambda c, i: F.coalesce(F.try_element_at("_n", i), F.lit(0).cast("bigint"))))

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["centroids"] = [_weighted_start(_matrix(c), np.asarray(n, np.float64), k, seed) for c, n, k in zip(pdf["centroids"], pdf["_n"], pdf["k"], strict=True)]
            yield pdf[[library_id, "k", "centroids"]]

    return rows.mapInPandas(reduced, T.StructType([chosen.schema[library_id], chosen.schema["k"], chosen.schema["centroids"]]))


def _weighted_start(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> list[list[float]]:
    """k of the candidates (fewer where these are) by k-means++ with weights."""
    rng = np.random.default_rng(seed)
    picked = [int(np.argmax(rng.random(len(weights)) ** (1 / np.maximum(weights, 1e-9))))]
    while len(picked) < k:
        far = weights * (1 - (candidates @ candidates[picked].T).max(axis=1)) ** 2
        # Rounding leaves a chosen one a little weight.
        far[picked] = 0
        if far.sum() <= 1e-18:
            break
        picked.append(int(rng.choice(len(far), p=far / far.sum())))
    return candidates[picked].tolist()


def kmeans(vectors: DataFrame, k: int | None = None, initial: DataFrame | None = None, seed: int = 0,
           max_rounds: int | None = MAX_ROUNDS, library_id: str = "library_id") -> DataFrame:
    """Add ``cluster`` to every vector, and ``settled``: whether its library's assignments had stopped changing.

    With ``max_rounds`` None the rounds go on until all have. Each brings vectors
    closer to their means, so that comes; only restarts could work against it, and
    there are none after MAX_ROUNDS: a cluster lost then keeps its centroid.

    Libraries with at most k vectors get one cluster per vector. All other
    libraries run together; one leaves the loop when none of its assignments
    changes. Only centroids are kept between rounds, by the driver where they are few
    and in tables where not: the assignment before is worked out again from the
    centroids before. A cluster that lost its members restarts from a drawn vector.
    """
    counts = vectors.groupBy(library_id).agg(F.count("*").alias("n"))
    sizes = counts.withColumn("k", F.lit(k) if k else default_k(F.col("n")))
    few = sizes.where(F.col("n") <= F.col("k")).select(library_id)
    trivial = with_positions(vectors.join(few, library_id, "left_semi"), [library_id],
                             [F.col("ordinal").asc()], out="cluster").withColumns({"cluster": F.col("cluster").cast("int"), "settled": F.lit(True)})
    big = cut_lineage(vectors.join(few, library_id, "left_anti"))
    many = cut_lineage(sizes.where(F.col("n") > F.col("k")))
    # Both the current and the previous centroids may have to travel.
    numbers = (many.agg(F.sum("k")).first()[0] or 0) * (big.agg(F.max(F.size("embedding"))).first()[0] or 0)
    small = 2 * numbers * 8 <= BROADCAST_BYTES
    start = initial if initial is not None else seed_centroids(big, many, seed, library_id, small)
    final = (_rounds_here if small else _rounds_in_tables)(big, start, seed, max_rounds, library_id)
    assigned = against_centroids(big, final, _nearest, {"cluster": "centroids"}, library_id, small)
    known = final.select(library_id, "settled")
    assigned = assigned.join(F.broadcast(known) if small else known, library_id)
    return assigned.withColumn("cluster", F.col("cluster").cast("int")).unionByName(trivial)


def _counted(max_rounds: int | None) -> Iterator[int]:
    return itertools.count() if max_rounds is None else iter(range(max_rounds))


def _means(stepped: DataFrame, library_id: str) -> DataFrame:
    """Centroid of each cluster that has members, and how many of these were elsewhere before."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding"))))
    return stepped.groupBy(library_id, F.col("cluster").cast("int").alias("cluster")).agg(
        unit_vector(mean).alias("centroid"), F.count_if(F.col("cluster") != F.col("_before")).alias("_moved"))


def _means_here(vectors: DataFrame, shared: Broadcast, library_id: str) -> DataFrame:
    """``_means`` with broadcast centroids, now and before, of every library that ``vectors`` has: a task sums up its vectors of each cluster."""
    kind = vectors.schema[library_id].dataType

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            codes = coded.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            cuts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
            for lib, first, last in zip(coded.dictionary.to_pylist(), cuts[:-1], cuts[1:], strict=True):
                own, (now, before) = rows[order[first:last]], shared.value[lib]
                at = np.argmax(own @ now.T, axis=1)
                was = 0 if before is None else np.argmax(own @ before.T, axis=1)
                sums, counts, moved = totals.setdefault(lib, (np.zeros(now.shape), np.zeros(len(now), np.int64), np.zeros(len(now), np.int64)))
                sums += (at == np.arange(len(now))[:, None]).astype(np.float64) @ own
                counts += np.bincount(at, minlength=len(now))
                moved += np.bincount(at[at != was], minlength=len(now))
        for lib, (sums, counts, moved) in totals.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array([lib] * len(found), types[0]), pa.array(found, types[1]), pa.array((sums[found] / counts[found, None]).tolist(), types[2]),
                pa.array(counts[found].astype(np.float64)), pa.array(moved[found])], names)

    out = T.StructType([T.StructField(library_id, kind), T.StructField("cluster", T.IntegerType()), T.StructField("_mean", T.ArrayType(T.DoubleType())),
                        T.StructField("_n", T.DoubleType()), T.StructField("_moved", T.LongType())])
    types, names = to_arrow_schema(out).types, out.names
    parts = vectors.select(library_id, "embedding").mapInArrow(summed, out)
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("_mean")), F.col("_n")))
    return parts.groupBy(library_id, "cluster").agg(unit_vector(mean).alias("centroid"), F.sum("_moved").alias("_moved"))


def _spare(big: DataFrame, most: int, seed: int, round_no: int, library_id: str) -> DataFrame:
    """The first ``most`` vectors of each library in the order drawn for this round."""
    by_draw = Window.partitionBy(library_id).orderBy(_u01(F.lit(seed), F.lit(1000 + round_no), "ordinal"), "ordinal")
    return big.withColumn("_no", F.row_number().over(by_draw)).where(F.col("_no") <= most).select(
        library_id, "_no", F.transform("embedding", lambda x: x.cast("double")).alias("_spare"))


def _rounds_here(big: DataFrame, start: DataFrame, seed: int, max_rounds: int | None, library_id: str) -> DataFrame:
    """The rounds where the centroids of all libraries may be broadcast: (library_id, centroids, settled).

    The driver holds these centroids anyway, so it keeps them from round to round: a
    round is one job that returns a row per cluster, and no plan or table grows with
    the rounds.
    """
    spark = big.sparkSession
    one = T.StructType([big.schema[library_id]])
    active = {lib: [_matrix(c), None] for lib, c in start.select(library_id, "centroids").collect()}
    done, libraries = [], None
    for round_no in _counted(max_rounds):
        if not active:
            break
        if libraries is None:
            libraries = spark.createDataFrame([(lib,) for lib in active], one)
        shared = spark.sparkContext.broadcast(active)
        present = big.join(F.broadcast(libraries), library_id, "left_semi")
        found = {(r[0], r["cluster"]): r for r in _means_here(present, shared, library_id).collect()}
        shared.destroy()
        moving = {lib for (lib, _), r in found.items() if r["_moved"]}
        if len(moving) < len(active):
            done += [(lib, old.tolist(), True) for lib, (old, _) in active.items() if lib not in moving]
            active, libraries = {lib: active[lib] for lib in active if lib in moving}, None
        stepped = {lib: [found[lib, i]["centroid"] if (lib, i) in found else None for i in range(len(old))] for lib, (old, _) in active.items()}
        if round_no >= MAX_ROUNDS and max_rounds is None:
            stepped = {lib: [old if new is None else new for new, old in zip(step, active[lib][0], strict=True)] for lib, step in stepped.items()}
        lost = {lib: [i for i, c in enumerate(step) if c is None] for lib, step in stepped.items() if any(c is None for c in step)}
        if lost:
            # Each lost cluster gets a vector of its own: the first drawn to the first lost one, and so on.
            few = big.join(F.broadcast(spark.createDataFrame([(lib,) for lib in lost], one)), library_id, "left_semi")
            for lib, no, vector in _spare(few, max(map(len, lost.values())), seed, round_no, library_id).collect():
                if no <= len(lost[lib]):
                    stepped[lib][lost[lib][no - 1]] = vector
        active = {lib: [_matrix(step), active[lib][0]] for lib, step in stepped.items()}
    # A library still moving at the last round keeps the assignment it had then.
    done += [(lib, None if old is None else old.tolist(), False) for lib, (_, old) in active.items()]
    return cut_lineage(spark.createDataFrame(done, T.StructType([
        *one, T.StructField("centroids", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("settled", T.BooleanType())])))


def _rounds_in_tables(big: DataFrame, start: DataFrame, seed: int, max_rounds: int | None, library_id: str) -> DataFrame:
    """The rounds for any number of libraries: (library_id, centroids, settled). What has settled is stored as it does, so no plan grows with the rounds."""
    spark = big.sparkSession
    active = cut_lineage(start.select(library_id, F.transform(
        "centroids", lambda c: F.transform(c, lambda x: x.cast("double"))).alias("centroids")))
    active = active.withColumn("previous", F.lit(None).cast(active.schema["centroids"].dataType))
    path, were = f"{shared_dir(spark)}/albumforge-settled-{uuid.uuid4().hex}", active.count()
    for round_no in _counted(max_rounds):
        stepped = against_centroids(big, active, _nearest, {"cluster": "centroids", "_before": "previous"}, library_id, False)
        found = cut_lineage(_means(stepped, library_id))
        moving = found.groupBy(library_id).agg(F.sum("_moved").alias("_moved")).where("_moved > 0").select(library_id)
        ended = active.join(moving, library_id, "left_anti").select(library_id, "centroids", F.lit(True).alias("settled"))
        slots = active.join(moving, library_id, "left_semi").select(
            library_id, F.posexplode("centroids").alias("cluster", "_old"))
        filled = slots.join(found.drop("_moved"), [library_id, "cluster"], "left")
        if round_no >= MAX_ROUNDS and max_rounds is None:
            filled = filled.withColumn("centroid", F.coalesce("centroid", "_old"))
        active = cut_lineage(_pack(filled, library_id))
        left, lost = active.agg(F.count("*"), F.max("_lost")).first()
        if left < were:
            ended.write.mode("append").parquet(path)
        were = left
        if lost:
            # Each lost cluster gets a vector of its own: the first drawn to the first lost one, and so on.
            by_slot = Window.partitionBy(library_id).orderBy("cluster")
            gone = filled.where("centroid IS NULL").select(library_id, "cluster", F.row_number().over(by_slot).alias("_no"))
            refill = gone.join(_spare(big, lost, seed, round_no, library_id), [library_id, "_no"]).drop("_no")
            refilled = filled.join(refill, [library_id, "cluster"], "left").withColumn("centroid", F.coalesce("centroid", "_spare"))
            active = cut_lineage(_pack(refilled, library_id))
        active = active.drop("_lost")
        if not left:
            break
    # A library still moving at the last round keeps the assignment it had then.
    rest = active.select(library_id, F.col("previous").alias("centroids"), F.lit(False).alias("settled"))
    rest.write.mode("append").parquet(path)
    return spark.read.schema(rest.schema).parquet(path)


def _pack(slots: DataFrame, library_id: str) -> DataFrame:
    """Centroid rows (at most k per library) to arrays, new and old, and the number of lost ones."""
    rows = F.array_sort(F.collect_list(F.struct("cluster", "centroid", "_old")))
    return slots.groupBy(library_id).agg(rows.alias("_rows"), F.count_if(F.col("centroid").isNull()).alias("_lost")).select(
        library_id, F.transform("_rows", lambda r: r["centroid"]).alias("centroids"),
        F.transform("_rows", lambda r: r["_old"]).alias("previous"), "_lost")


def order_clusters(assigned: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Number clusters by their earliest photo, undated ones next, photos without a vector last.

    ``assigned`` has ``cluster`` (null without a vector). A library without any
    vector becomes one cluster.
    """
    first = F.min("ts").alias("_first")
    groups = assigned.groupBy(library_id, "cluster").agg(first)
    w = Window.partitionBy(library_id).orderBy(
        F.col("cluster").isNull().cast("int"), F.col("_first").asc_nulls_last(), F.col("cluster"))
    numbered = groups.select(library_id, F.col("cluster").alias("_c"), (F.row_number().over(w) - 1).alias("cluster_idx"))
    on = F.col("cluster").eqNullSafe(F.col("_c"))
    return assigned.alias("a").join(numbered.withColumnRenamed(library_id, "_l"),
                                    on & (F.col(f"a.{library_id}") == F.col("_l"))).drop("_l", "_c", "cluster")


def semantic_clusters(photos: DataFrame, k: int | None = None, initial: DataFrame | None = None, seed: int = 0,
                      library_id: str = "library_id", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Photos with ``cluster_idx`` by similarity of ``embedding``; ``initial``: given start centroids of each library."""
    vectors = photos.where(F.col("embedding").isNotNull()).select(library_id, "photo_id", "ordinal", "embedding")
    found = kmeans(vectors, k, initial, seed, max_rounds, library_id).select(library_id, "photo_id", "cluster")
    return order_clusters(photos.join(found, [library_id, "photo_id"], "left"), library_id)


def place_semantic(clustered: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Positions by time (undated last), then input order; photos without a vector stay in input order."""
    has_vector = F.col("embedding").isNotNull()
    return with_positions(clustered, [library_id, "cluster_idx"],
                          [F.when(has_vector, F.col("ts")).asc_nulls_last(), F.col("ordinal").asc()], size="cluster_size")
