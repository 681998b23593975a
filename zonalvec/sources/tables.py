"""Pooled tables, results tables and file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import exists

RESULTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("pool", "split_type", "probe")] + [T.StructField("train_samples", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in ("accuracy", "f1_macro")]
)


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, stem, class_name, length) of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return files.select("path", stem.alias("stem"), F.substring_index(stem, "_", 1).alias("class_name"), "length")


def write_pooled(pooled: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(method, split_type, role, patch_id, label, features) by method and split; overwriting replaces only partitions that are written."""
    pooled.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("method", "split_type", "role").parquet(path)


def read_pooled(spark: SparkSession, path: str, method: str | None = None, split_type: str | None = None, role: str | None = None) -> DataFrame:
    """Filters on method and split prune folders."""
    rows = spark.read.parquet(path)
    for column, value in (("method", method), ("split_type", split_type), ("role", role)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    return rows


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", "true").csv(path)


def read_results(spark: SparkSession, paths: dict[str, str], schema: T.StructType = RESULTS) -> DataFrame:
    """The union of results by dataset; datasets whose path does not exist are left out."""
    out = None
    for dataset, path in paths.items():
        if not exists(spark, path):
            continue
        rows = spark.read.csv(path, header=True, schema=schema).withColumn("dataset", F.lit(dataset))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("dataset", T.StringType())]))


def write_routed(rows: DataFrame, path: str, column: str = "class_name") -> None:
    """Outputs in one folder a class."""
    rows.write.mode("overwrite").partitionBy(column).parquet(path)
