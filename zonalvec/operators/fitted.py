"""Pooling methods that are fitted on training rows: principal components and a codebook of visual words.

Fitted objects are separate types: only ``fit`` makes one, so transforming before fitting cannot be written
without an error. What comes to the driver is one d x d moment matrix or K centres, whatever the row count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import children, new_folder, removed


#: Of wide vectors: rows that a task multiplies at a time, and values of a sum that travel together.
WIDE_ROWS, STRIPE = 64, 4096
#: Pixels of a batch that one task reads, about.
SPLIT = 65_536


class NotFitted(RuntimeError):
    pass


# -- principal components ---------------------------------------------------------------------------------


def moments(rows: DataFrame, shift: list[float] | None = None) -> DataFrame:
    """Mergeable moments (i, j, n, s) of ``features``: s is the sum of x_i x_j; j = -1 holds the sums of x_i.

    Values are taken relative to ``shift`` to avoid cancellation. Tasks add up their rows in one array each, so
    one row a pair and task is shuffled.
    """
    base = None if shift is None else np.array(shift)

    def run(batches):
        n, sums, squares = 0, None, None
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["features"].to_numpy()).astype(float)
            x = x if base is None else x - base
            n += len(x)
            sums = x.sum(0) if sums is None else sums + x.sum(0)
            squares = x.T @ x if squares is None else squares + x.T @ x
        if n:
            d = len(sums)
            i, j = np.triu_indices(d)
            yield pd.DataFrame({"i": np.r_[np.arange(d), i], "j": np.r_[np.full(d, -1), j], "n": n, "s": np.r_[sums, squares[i, j]]})

    return rows.select("features").mapInPandas(run, "i int, j int, n long, s double").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def merge_moments(*parts: DataFrame) -> DataFrame:
    """Moments with the same shift of several batches."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


@dataclass(frozen=True)
class PCAModel:
    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    total_variance: float

    def transform(self, rows: DataFrame, column: str = "features") -> DataFrame:
        """``column`` centred and projected; the basis is a literal of k x d values."""
        mean, basis = self.mean, self.components

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            return pd.Series(list((np.stack(v.to_numpy()).astype(float) - mean) @ basis.T)) if len(v) else v

        return rows.withColumn(column, project(column))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(component, pos, loading, variance)."""
        rows = [(k, i, float(x), float(self.variance[k])) for k, c in enumerate(self.components) for i, x in enumerate(c)]
        return spark.createDataFrame(rows, "component int, pos int, loading double, variance double")


def pca_from_moments(found: DataFrame, k: int, shift: list[float] | None = None) -> PCAModel:
    """Eigenvectors of the covariance; each sign makes the largest loading positive."""
    got = found.toPandas()
    d = int(got["i"].max()) + 1
    if k > d:
        raise ValueError(f"{k} components of {d} dimensions")
    n = int(got["n"].iloc[0])
    sums, square = np.zeros(d), np.zeros((d, d))
    first = got[got["j"] < 0]
    sums[first["i"]] = first["s"]
    rest = got[got["j"] >= 0]
    square[rest["i"], rest["j"]] = rest["s"]
    square[rest["j"], rest["i"]] = rest["s"]
    cov = (square - np.outer(sums, sums) / n) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    basis = vectors[:, order].T
    basis = basis * np.where(basis[np.arange(k), np.abs(basis).argmax(1)] < 0, -1, 1)[:, None]
    return PCAModel(sums / n + (0 if shift is None else np.array(shift)), basis, np.maximum(values[order], 0), float(np.trace(cov)))


def means(rows: DataFrame) -> list[float]:
    got = rows.select(F.posexplode("features").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m")).orderBy("pos").collect()  # one row a dimension
    return [r["m"] for r in got]


# -- principal components of wide vectors -------------------------------------------------------------------


def _added(rows: DataFrame, what, width: int) -> np.ndarray:
    """Sums of what(x) over blocks of rows: an array a task, cut into stripes that are added up in tasks; one sum a stripe comes to the driver."""
    import pyarrow as pa

    def each(batches):
        held = None
        for batch in batches:
            for i in range(0, batch.num_rows, WIDE_ROWS):
                some = batch.column(0).slice(i, WIDE_ROWS)
                found = what(some.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(some), -1))
                held = found if held is None else held + found
        if held is not None:
            for at in range(0, len(held), STRIPE):
                yield pa.RecordBatch.from_arrays([pa.array([at // STRIPE]), pa.array([held[at : at + STRIPE].tobytes()])], ["stripe", "v"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[k] = held[k] + np.frombuffer(v) if k in held else np.frombuffer(v)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v.tobytes() for v in held.values()])], ["stripe", "v"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stripes = rows.select("features").mapInArrow(each, "stripe long, v binary").repartition(parts, "stripe").mapInArrow(merge, "stripe long, v binary").collect()
    return np.concatenate([np.frombuffer(r["v"]) for r in sorted(stripes, key=lambda r: r["stripe"])]).reshape(-1, width)


def fit_wide(rows: DataFrame, k: int, oversample: int = 8, passes: int = 30, tolerance: float = 1e-10, seed: int = 42) -> PCAModel:
    """Principal components of vectors that are too wide for a d x d matrix (flattened patches): block power iteration on a seeded sketch.

    A pass multiplies each task's rows by the sketch (d x (k + oversample)) and back, adds up the products by stripes and makes the
    sketch orthonormal again, so tasks and driver hold O(d k) values whatever the number of rows. It ends when the variances of the k leading
    directions change by no more than ``tolerance`` of their sum. With no more rows than the sketch is wide one pass is exact.
    """
    first = rows.select(F.size("features").alias("d")).first()
    if first is None or not first["d"]:
        raise ValueError("no vectors")
    d = first["d"]
    if k > d:
        raise ValueError(f"{k} components of {d} dimensions")
    spark, kept = rows.sparkSession, rows.filter("features is not null").select("features")
    sums = _added(kept, lambda x: np.r_[[len(x)], x.sum(0)][:, None], 1)[:, 0]
    n, mean = sums[0], sums[1:] / sums[0]
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(d, k + oversample))))[0]
    before, variance, total = None, None, 0.0
    for _ in range(passes):
        sent = spark.sparkContext.broadcast((mean, basis))

        def product(x, sent=sent):
            mean, basis = sent.value
            x = x - mean
            return np.vstack([x.T @ (x @ basis), np.full((1, basis.shape[1]), (x * x).sum())])

        found = _added(kept, product, basis.shape[1])
        sent.unpersist()
        total, found = found[-1, 0] / max(n - 1, 1), found[:-1] / max(n - 1, 1)
        # Rayleigh quotients on the old basis, then the new one.
        small = basis.T @ found
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")
        ritz, variance = basis @ turn[:, order], values[order]
        if before is not None and np.abs(variance[:k] - before[:k]).max() <= tolerance * max(variance.sum(), 1e-300):
            break
        before, basis = variance, np.linalg.qr(found)[0]
    components = ritz[:, :k].T
    components = components * np.where(components[np.arange(k), np.abs(components).argmax(1)] < 0, -1, 1)[:, None]
    return PCAModel(mean, components, np.maximum(variance[:k], 0), float(total))


class PCA:
    """Estimator over ``features`` (float or double arrays)."""

    def __init__(self, k: int = 64):
        self.k, self.model = k, None

    def fit(self, rows: DataFrame) -> PCAModel:
        shift = means(rows)
        self.model = pca_from_moments(moments(rows, shift), self.k, shift)
        return self.model

    def transform(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotFitted("fit the PCA first")
        return self.model.transform(rows)

    def fit_transform(self, rows: DataFrame) -> DataFrame:
        return self.fit(rows).transform(rows)


# -- codebook ----------------------------------------------------------------------------------------------


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def assign(pixels: DataFrame, codebook: DataFrame, vector: str = "vec") -> DataFrame:
    """pixels with ``cluster``: the nearest centre, ties (at nine digits) to the lowest number.

    The codebook is one array of K centres, sent with the plan; no pair of pixel and centre becomes a row.
    """
    centres = codebook.agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("_book"))
    nearest = F.array_min(F.transform("_book", lambda c: F.struct(F.round(squared_distance(F.col(vector), c["centre"]), 9).alias("d"), c["cluster"].alias("cluster"))))
    return pixels.crossJoin(F.broadcast(centres)).withColumn("cluster", nearest["cluster"]).drop("_book")


def encode(assigned: DataFrame, k: int) -> DataFrame:
    """(patch_id, ord, value): share of each of k bins among a patch's pixels; every bin is there."""
    counts = assigned.groupBy("patch_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("patch_id").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "n"))).alias("m"), F.sum("n").alias("total"))
    bins = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda b: F.coalesce(F.get(F.transform(F.array(b), lambda x: F.try_element_at("m", x)), F.lit(0)), F.lit(0)) / F.greatest("total", F.lit(1))))
    return maps.select("patch_id", bins.alias("ord", "value"))


def lloyd_step(assigned: DataFrame, vector: str = "vec") -> DataFrame:
    """(cluster, band, value, n): the mean of each cluster's members."""
    rows = assigned.select("cluster", F.posexplode(vector).alias("band", "v"))
    return rows.groupBy("cluster", "band").agg(F.avg(F.col("v").cast("double")).alias("value"), F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class BoVWModel:
    centres: np.ndarray

    def codebook(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centres)], "cluster int, centre array<double>")

    def transform(self, pixels: DataFrame) -> DataFrame:
        return encode(assign(pixels, self.codebook(pixels.sparkSession)), len(self.centres))


class BoVW:
    """Codebook by Spark ML's k-means over training pixels."""

    def __init__(self, k: int = 128, seed: int = 42, iterations: int = 20):
        self.k, self.seed, self.iterations, self.model = k, seed, iterations, None

    def fit(self, pixels: DataFrame, vector: str = "vec") -> BoVWModel:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = pixels.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
        fitted = KMeans(k=self.k, seed=self.seed, maxIter=self.iterations).fit(rows)
        self.model = BoVWModel(np.array(sorted(map(tuple, fitted.clusterCenters()))))
        return self.model

    def transform(self, pixels: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotFitted("fit the codebook first")
        return self.model.transform(pixels)

    def fit_transform(self, pixels: DataFrame) -> DataFrame:
        return self.fit(pixels).transform(pixels)


def in_batches(pixels: DataFrame, batch: int, seed: int, *key: str) -> tuple[DataFrame, int]:
    """pixels with ``_batch``, and how many batches: a seeded shuffle by a hash of the key, cut into about ``batch`` pixels each."""
    n = max(1, -(-pixels.count() // batch))
    return pixels.withColumn("_batch", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(n))), n


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, seed: int, steps: int = 10) -> np.ndarray:
    """k centres of few weighted points: each next one drawn by weight and squared distance to those before it, then some steps to the means."""
    draw = np.random.default_rng(seed)
    centres = points[[draw.choice(len(points), p=weights / weights.sum())]]
    while len(centres) < min(k, len(points)):
        share = weights * _distances(points, centres).min(1)
        if share.sum() <= 0:
            break  # fewer different points than centres
        centres = np.vstack([centres, points[draw.choice(len(points), p=share / share.sum())]])
    for _ in range(steps):
        near = _distances(points, centres).argmin(1)
        for c in np.unique(near):
            centres[c] = np.average(points[near == c], axis=0, weights=weights[near == c])
    return centres


def seeded_centres(pixels: DataFrame, k: int, seed: int = 42, key: tuple[str, ...] = ("patch_id", "y", "x"), vector: str = "vec", rounds: int = 4) -> np.ndarray:
    """First centres by parallel seeding (k-means||): in each of some rounds a pixel becomes a candidate with a probability in proportion
    to its squared distance to the candidates before, 2 k of them expected; candidates are weighted by the pixels that are nearest to them
    and k are chosen from these by k-means++.

    Chances come from hashes of the key, so they don't depend on partitions. What comes to the driver are candidates, some 2 k a round whatever
    the number of pixels, and one sum. Null vectors are left out; no pixels: an error; fewer different pixels than k: as many centres.
    """
    rows = pixels.filter(F.col(vector).isNotNull()).select(*key, F.transform(vector, lambda x: x.cast("double")).alias(vector))
    first = rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(1).collect()
    if not first:
        raise ValueError("no pixels")
    found = np.array([first[0][vector]])
    for n in range(rounds):
        book = BoVWModel(found).codebook(pixels.sparkSession).agg(F.collect_list("centre").alias("_book"))
        far = rows.crossJoin(F.broadcast(book)).withColumn("_d", F.array_min(F.transform("_book", lambda c: squared_distance(F.col(vector), c)))).drop("_book")
        total = far.agg(F.sum("_d")).first()[0]
        if not total:
            break
        chance = F.pmod(F.xxhash64(F.lit(seed + 1 + n), *key), F.lit(1 << 52)) / float(1 << 52)
        more = sorted(far.filter(chance < F.col("_d") * (2.0 * k / total)).select(vector).distinct().collect())  # in whatever order they came
        found = np.vstack([found, *[[r[vector]] for r in more]]) if more else found
    near = assign(rows, BoVWModel(found).codebook(pixels.sparkSession), vector).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()
    near = sorted((r["cluster"], r["n"]) for r in near)
    return _plus_plus(found[[c for c, _ in near]], np.array([n for _, n in near], float), k, seed)


def fit_mini_batch(pixels: DataFrame, k: int, batch: int = 100_000, epochs: int = 1, seed: int = 42, key: tuple[str, ...] = ("patch_id", "y", "x"), vector: str = "vec", starved: float = 0.01) -> BoVWModel:
    """A codebook from bounded batches of shuffled pixels. Centres are seeded from the first batch (``seeded_centres``), and each batch moves
    them by its clusters' means, weighted by counts. After a batch centres with less than ``starved`` of the pixels that the fullest one has begin
    again at pixels of that batch that lie farthest from theirs, with the least count of the others.

    Batches are folders of the written table, so each is read alone. K x d values come to the driver for each batch.
    """
    spark = pixels.sparkSession
    shuffled, n = in_batches(pixels, batch, seed, *key)
    folder, splits = new_folder(spark, "batches"), max(1, -(-batch // SPLIT))
    # A batch is a file, or a few for a large one: a task writes whole batches, and a batch is read by as many tasks as it has files.
    shuffled.repartition("_batch", F.pmod(F.xxhash64(F.lit(seed + 2), *key), F.lit(splits))).write.partitionBy("_batch").parquet(folder)
    have = {int(name.partition("=")[2]) for name in children(spark, folder) if name.startswith("_batch=")}
    numbers = [number for number in range(n) if number in have]
    if not numbers:
        raise ValueError("no pixels")
    read = lambda number: spark.read.schema(pixels.schema).parquet(f"{folder}/_batch={number}")
    centres = seeded_centres(read(numbers[0]), k, seed, key, vector)
    counts, last = np.zeros(len(centres)), epochs * len(numbers) - 1
    for at in range(last + 1):
        own = read(numbers[at % len(numbers)])
        sums, n_near = _near_sums(own, centres, vector)
        for c in np.flatnonzero(n_near):
            counts[c] += n_near[c]
            centres[c] += (sums[c] / n_near[c] - centres[c]) * n_near[c] / counts[c]
        poor = np.flatnonzero(counts < starved * counts.max())
        if len(poor) and at < last:
            book = BoVWModel(centres).codebook(spark)
            apart = assign(own, book, vector).join(F.broadcast(book), "cluster").select(*key, vector, squared_distance(F.col(vector), F.col("centre")).alias("_d"))
            taken = apart.orderBy(F.col("_d").desc(), *key).limit(len(poor)).collect()
            for c, r in zip(poor, taken):
                centres[c] = np.array(r[vector], float)
                counts[c] = np.delete(counts, poor).min()
    removed(spark, folder)
    return BoVWModel(centres)


def _near_sums(pixels: DataFrame, centres: np.ndarray, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each centre the sum and the number of the pixels nearest to it, as ``assign`` finds it: one job and one row a task, no exchange."""
    k, d = centres.shape

    def run(batches):
        sums, n = np.zeros((k, d)), np.zeros(k, np.int64)
        for batch in batches:
            column = batch.column(0).filter(batch.column(0).is_valid())
            x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            for i in range(0, len(x), 4096):
                own = x[i : i + 4096]
                near = np.round(((own[:, None] - centres) ** 2).sum(2), 9).argmin(1)
                np.add.at(sums, near, own)
                n += np.bincount(near, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()]), pa.array([n.tobytes()])], ["sums", "n"])

    found = pixels.select(vector).mapInArrow(run, "sums binary, n binary").collect()
    return sum((np.frombuffer(r["sums"]).reshape(k, d) for r in found), np.zeros((k, d))), sum((np.frombuffer(r["n"], np.int64) for r in found), np.zeros(k, np.int64))


def inertia(pixels: DataFrame, codebook: DataFrame, vector: str = "vec") -> DataFrame:
    """(n, inertia): the pixels and the sum of their squared distances to their centres."""
    near = assign(pixels, codebook, vector).join(F.broadcast(codebook), "cluster")
    return near.agg(F.count(F.lit(1)).alias("n"), F.sum(squared_distance(F.col(vector), F.col("centre"))).alias("inertia"))


def mini_batch_update(centres: np.ndarray, counts: np.ndarray, step: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Move centres towards a batch's cluster means by their share of all pixels seen (``step``: see lloyd_step)."""
    centres, counts = centres.copy(), counts.copy()
    for cluster, own in step.toPandas().groupby("cluster"):  # K x d rows
        n = int(own["n"].iloc[0])
        counts[cluster] += n
        centres[cluster] += (own.sort_values("band")["value"].to_numpy() - centres[cluster]) * n / counts[cluster]
    return centres, counts
