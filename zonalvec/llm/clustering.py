"""Centroid clustering in whole numbers, with heap-ordered bounds.

A vector is assigned exactly once: all distances are computed, and the gap between the distance to the second nearest centroid and
that to its own is stored. When centroids move, the gap shrinks by no more than what its own centroid moved and what the
others moved at most. Each cluster adds these up as its drift, and a vector is stored under its gap plus the drift that its cluster had then.
While that key is not below the drift, no other centroid can have become as near, ties included.

A cluster's heap is therefore its vectors in the order of their keys, and it is kept as sorted runs in the shared folder:
what is popped in a round is the range of keys from the cluster's drift before the round to the drift after it, which the scans prune by
their statistics. Only these vectors are read and rescanned; they are written as a new run under their new keys, which are at least the
drift after the round, so that an entry is live exactly as long as its key is not below its cluster's drift. Nothing is
deleted or rewritten, and a lost executor's part of a run is made again from earlier runs. Sums of components are corrected by
the vectors that changed their cluster. What comes to the driver is a sum for each cluster and component.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left out; an empty table gives
an empty one; with fewer vectors than clusters each is a centroid; rows with a null id are clustered, but are no first centroids; repeated
rows are clustered each for itself; components beyond ``LARGEST`` are an error, since their squared distances do not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, materialise, table

COMPONENTS, SCALE = 64, 256
CLUSTERS, ROUNDS, SALT = 40, 5, "2"
#: Components of a vector as whole numbers at most; squared distances then stay below 2 ** 59.
LARGEST = 1 << 25
#: Up to here products and their sums are exact as doubles.
EXACT = 1 << 21
#: Vectors a task scans at a time.
BLOCK = 4096
#: What rounding may take of a gap, beside its part of the distances.
SLACK, PART = 1e-6, 1e-12

RUN = "cluster int, key double, was int, vec_id long, v array<int>"


def whole(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, v): the vectors that are kept, with each component x as floor(SCALE * x)."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * float(SCALE)))
    fits = F.forall("v", lambda x: F.abs(x) <= LARGEST)
    kept = rows.filter(F.col(vector).isNotNull() & (F.size(vector) == components) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))
    checked = F.when(fits, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("too large a component in vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))))
    return kept.select("vec_id", F.transform(checked, lambda x: x.cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors with the least SHA-256 of ``salt:vec_id``, in that order; equal ids in the order of their components."""
    named = vectors.filter("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return np.array([r["v"] for r in named.orderBy("h", "v").limit(clusters).collect()], np.int64)  # one row a cluster


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances as longs; exact."""
    kind = np.float64 if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT else np.int64
    v, c = v.astype(kind), centroids.astype(kind)
    return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            some = batch.slice(i, BLOCK)
            yield some, some.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(some.num_rows, -1)


def scanned(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """rows (vec_id, v, was) -> a run: each with its nearest centroid (of equal ones the first) and its key; in the order of a heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, v in _blocks(batches):
            d = distances(v, centroids)
            own = d.argmin(1)
            near = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64)) if len(centroids) > 1 else np.c_[np.zeros(len(d)), np.full(len(d), np.inf)]
            gap = np.maximum(near[:, 1] - near[:, 0] - SLACK - PART * near.sum(1), 0) if len(centroids) > 1 else near[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(gap + drift[own]), some.column("was"), some.column("vec_id"), some.column("v")], ["cluster", "key", "was", "vec_id", "v"])

    return rows.select("vec_id", "v", "was").mapInArrow(run, RUN).sortWithinPartitions("cluster", "key")


def _within(low: np.ndarray, high: np.ndarray | None) -> Column:
    """Entries whose key lies in their cluster's range. What holds for all clusters comes first, for the scan's statistics."""
    of = lambda bounds: F.get(F.array(*[F.lit(float(x)) for x in bounds]), F.col("cluster"))
    out = (F.col("key") >= float(low.min())) & (F.col("key") >= of(low))
    return out if high is None else (F.col("key") < float(high.max())) & out & (F.col("key") < of(high))


def _changes(run: DataFrame, clusters: int) -> tuple[list[list[int]], list[int]]:
    """What the entries of a run that changed their cluster add to the sums and counts; one row a cluster comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = None, np.zeros(clusters, np.int64)
        for some, v in _blocks(batches):
            sums = np.zeros((clusters, v.shape[1]), np.int64) if sums is None else sums
            for column, sign in (("cluster", 1), ("was", -1)):
                at = some.column(column).to_numpy()
                there = at >= 0
                np.add.at(sums, at[there], sign * v[there])
                counts += sign * np.bincount(at[there], minlength=clusters)
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(clusters, dtype=np.int32)), pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    parts = run.filter("cluster <> was").select("cluster", "was", "v").mapInArrow(add, "cluster int, n long, s array<long>")
    long = parts.select("cluster", "n", F.posexplode("s").alias("pos", "s")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    sums, counts = {}, [0] * clusters
    for r in long.collect():
        sums[r["cluster"], r["pos"]] = r["s"]
        counts[r["cluster"]] = r["n"]
    width = 1 + max((p for _, p in sums), default=-1)
    return [[sums.get((j, p), 0) for p in range(width)] for j in range(clusters)], counts


def moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much less a gap can be, for each cluster, after its centroids have moved; rounded up."""
    own = np.array([sqrt(d) * (1 + PART) + SLACK if (d := sum(int(x) ** 2 for x in a - b)) < 1 << 100 else float(isqrt(d) + 1) for a, b in zip(old, new)])
    others = np.array([max(np.delete(own, j), default=0.0) for j in range(len(own))])
    return own + others


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT, watch: list | None = None) -> tuple[DataFrame, np.ndarray]:
    """vectors (vec_id, v) -> (vec_id, cluster, distance) after the last assignment, and the last centroids.

    ``watch`` gets the number of vectors that each assignment rescans.
    """
    centroids = first_centroids(vectors, clusters, salt)
    k = len(centroids)
    if not k:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter("false"), centroids
    drift = np.zeros(k)
    runs = [materialise(scanned(vectors.withColumn("was", F.lit(-1)), centroids, drift), "cluster-run")]
    sums, counts = np.zeros(centroids.shape, object), np.zeros(k, object)
    for _ in range(rounds):
        added, more = _changes(runs[-1], k)
        if any(map(any, added)) or any(more):
            sums, counts = sums + np.array(added, object), counts + np.array(more, object)
        moved = np.array([[s // n for s in row] if n else list(c) for row, n, c in zip(sums, counts, centroids)], np.int64)
        later = drift + moves(centroids, moved)
        popped = reduce(DataFrame.unionByName, [r.filter(_within(drift, later)) for r in runs]).select("vec_id", "v", F.col("cluster").alias("was"))
        centroids, drift = moved, later
        runs.append(materialise(scanned(popped, centroids, drift), "cluster-run"))
    if watch is not None:
        watch += [r.count() for r in runs]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, v in _blocks(batches):
            apart = v - centroids[some.column("cluster").to_numpy()]
            yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("cluster"), pa.array((apart * apart).sum(1))], ["vec_id", "cluster", "distance"])

    live = reduce(DataFrame.unionByName, [r.filter(_within(drift, None)) for r in runs]).select("vec_id", "cluster", "v")
    found = materialise(live.mapInArrow(measure, "vec_id long, cluster int, distance long"), "clusters")
    dropped(*runs)
    return found, centroids


def described(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256. One row a cluster is sent to the tasks."""
    digests = [(j, hashlib.sha256(",".join(map(str, map(int, c))).encode()).hexdigest()) for j, c in enumerate(centroids)]
    names = found.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    all_in = own.agg(F.sum("cluster_inertia").alias("inertia"))
    return found.join(F.broadcast(names), "cluster").join(F.broadcast(own), "cluster").crossJoin(F.broadcast(all_in)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return described(*fit(whole(table(spark, sf_dir, "embeddings"))))
