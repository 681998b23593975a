"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Of tables that ``written`` made: their folders.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_own: WeakKeyDictionary[SparkSession, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a temporary folder in local mode, as in tests; on a cluster
    executors would not see such a folder, and so it is an error there."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark not in _own:
        _own[spark] = "file://" + tempfile.mkdtemp(prefix="zonalvec-")
    return _own[spark]


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors.

    ``instead_of``: a table from an earlier call that nothing reads any more once this one is written; its files go.
    """
    path = new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    if instead_of is not None:
        dropped(instead_of)
    return out


def _at(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as Hadoop's objects."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    store, where = _at(spark, path)
    return [f.getPath().getName() for f in store.listStatus(where)] if store.exists(where) else []


def removed(spark: SparkSession, path: str) -> None:
    store, where = _at(spark, path)
    store.delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Remove the files of tables that ``written`` made; others are left alone."""
    for df in tables:
        if path := _folders.pop(df, None):
            store, where = _at(df.sparkSession, path)
            store.delete(where, True)
