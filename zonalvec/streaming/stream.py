"""The same aggregations over arriving batches. Sources are file streams, or whatever Spark reads as a stream.

Aggregates of minimum, maximum, mean and deviation keep a few numbers a group. Exact percentiles keep a
group's distinct values in the state: use them for bounded groups, or the approximate form for others.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fitted import BoVWModel, PCAModel, assign, encode, lloyd_step, merge_moments, mini_batch_update, moments, pca_from_moments
from ..storage import children, exists, new_folder, removed


def folder_stream(spark: SparkSession, like: DataFrame, path: str, files: int = 1) -> DataFrame:
    """A stream over a folder's Parquet files, some per batch, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def arriving(df: DataFrame, batches: int) -> DataFrame:
    """A table as a stream of some batches: written to the shared folder and read as it would arrive.

    Each batch is as many files as the session has shuffle partitions, so a batch is read in many tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = new_folder(df.sparkSession, "arriving")
    df.repartition(batches * parts).write.parquet(path)
    return folder_stream(df.sparkSession, df, path, parts)


def arriving_parts(*parts: DataFrame) -> DataFrame:
    """A stream of the given tables, one file and batch each, in their order."""
    spark, path = parts[0].sparkSession, new_folder(parts[0].sparkSession, "arriving")
    for n, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(path)
        if n + 1 < len(parts):
            time.sleep(1.1)  # files are taken in the order of their times, of which some stores keep seconds
    return folder_stream(spark, parts[0], path)


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is available, and read what its last state is.

    In update and complete mode every batch's rows are written with the batch's number; the newest of each key,
    or the last batch, is the result.
    """
    spark = stream.sparkSession
    out, state = new_folder(spark, "stream-out"), new_folder(spark, "stream-state")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    if mode == "complete":
        last = rows.agg(F.max("_batch").alias("_last"))
        return rows.join(F.broadcast(last), F.col("_batch") == F.col("_last")).drop("_batch", "_last")
    return rows


def newest(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows of each key's last update."""
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def zone_stats(rows: DataFrame, zone: str = "zone", value: str = "v") -> DataFrame:
    """Minimum, maximum, mean and population deviation of each zone, from one pass."""
    v = F.col(value)
    return rows.groupBy(zone).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def zone_percentiles(rows: DataFrame, zone: str = "zone", value: str = "v", of: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    return rows.groupBy(zone).agg(*[F.percentile(value, F.lit(q)).alias(f"p{round(q * 100)}") for q in of])


def zone_covariance(rows: DataFrame, a: str, b: str, zone: str = "zone") -> DataFrame:
    return rows.groupBy(zone).agg(F.covar_samp(a, b).alias("cov"))


def window_stats(rows: DataFrame, time: str, length: str, late: str, zone: str = "zone", value: str = "v", slide: str | None = None) -> DataFrame:
    """Zone statistics by tumbling (or sliding) windows of event time; rows later than the watermark are left out."""
    when = F.window(time, length, slide) if slide else F.window(time, length)
    return rows.withWatermark(time, late).groupBy(when.alias("w"), zone).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), zone, "n", "mean")


def each_batch(stream: DataFrame, do: Callable[[DataFrame, int], None]) -> None:
    """Run ``do`` on every available batch, with the stream's progress kept in the shared folder."""
    state = new_folder(stream.sparkSession, "stream-state")
    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(do).start().awaitTermination()


def folded(stream: DataFrame, part: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """A table that all available batches are merged into: ``part`` makes mergeable rows of a batch, ``merge`` makes one row a key of
    such rows and those so far. For aggregates that the stream's own state can't keep, such as vectors of moments and sketches.

    The table after each batch lies beside the stream's progress under the batch's number. A repeated batch begins from the table
    before it, a later call with the same folder goes on where the first one ended, and older tables are removed, so what
    is kept grows with the keys and not with the batches. Nothing has arrived: no rows.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, "folded")
    at = lambda number: f"{folder}/tables/b={number}"

    def add(batch: DataFrame, number: int) -> None:
        rows = part(batch)
        if number:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(at(number - 1)))
        merge(rows).write.mode("overwrite").parquet(at(number))
        if number > 1:
            removed(spark, at(number - 2))

    stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    numbers = [int(name.partition("=")[2]) for name in children(spark, f"{folder}/tables")]
    if not numbers:
        return merge(part(spark.createDataFrame([], stream.schema)))
    return spark.read.parquet(at(max(numbers)))


BOOK = "batch int, cluster int, centre array<double>, seen double"


def fit_codebook(stream: DataFrame, first: np.ndarray, vector: str = "vec", folder: str | None = None) -> np.ndarray:
    """Centres after all available batches: each batch moves them by its clusters' means, weighted by counts.

    The centres after every batch are kept in the folder with the batch's number, beside the stream's progress. A
    repeated batch begins from the centres before it, and a later call with the same folder goes on where the first one ended.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, "codebook")

    def put(number: int, centres: np.ndarray, counts: np.ndarray) -> None:
        rows = [(number, i, [float(x) for x in c], float(n)) for i, (c, n) in enumerate(zip(centres, counts))]
        spark.createDataFrame(rows, BOOK).coalesce(1).write.mode("overwrite").parquet(f"{folder}/books/b={number}")

    def last(before: int | None) -> tuple[np.ndarray, np.ndarray]:
        rows = spark.read.schema(BOOK).option("recursiveFileLookup", "true").parquet(f"{folder}/books")
        rows = rows if before is None else rows.filter(F.col("batch") < before)
        newest = rows.agg(F.max("batch")).first()[0]
        found = rows.filter(F.col("batch") == newest).orderBy("cluster").collect()  # K centres
        return np.array([r["centre"] for r in found]), np.array([r["seen"] for r in found])

    def learn(batch: DataFrame, number: int) -> None:
        centres, counts = last(number)
        put(number, *mini_batch_update(centres, counts, lloyd_step(assign(batch, BoVWModel(centres).codebook(spark), vector), vector)))

    if not exists(spark, f"{folder}/books"):
        put(-1, np.array(first, float), np.zeros(len(first)))
    stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(learn).start().awaitTermination()
    return last(None)[0]


def fit_pca(stream: DataFrame, k: int, shift: list[float] | None = None) -> PCAModel:
    """Principal components from the merged moments of all available batches: exact, whatever the batches."""
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession, "moments")

    def add(batch: DataFrame, number: int) -> None:
        moments(batch, shift).write.mode("overwrite").parquet(f"{folder}/b={number}")

    each_batch(stream, add)
    return pca_from_moments(merge_moments(spark.read.option("recursiveFileLookup", "true").parquet(folder)), k, shift)


def encode_arriving(stream: DataFrame, codebook: DataFrame, k: int) -> DataFrame:
    """Patch histograms of arriving patches under a fixed codebook; a patch's pixels arrive in one batch."""
    folder = new_folder(stream.sparkSession, "encoded")

    def put(batch: DataFrame, number: int) -> None:
        encode(assign(batch, codebook), k).write.mode("overwrite").parquet(f"{folder}/b={number}")

    each_batch(stream, put)
    return stream.sparkSession.read.option("recursiveFileLookup", "true").parquet(folder)
