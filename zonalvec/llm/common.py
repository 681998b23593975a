"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, new_folder, written

#: Words of the scanning contracts, after A-Z are lower-cased: runs of anything but ASCII non-alphanumerics.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, what: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors. The files of ``instead_of``,
    an earlier such table that nothing reads any more, go afterwards."""
    return written(df, what, instead_of)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def row_id_fold(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo: decides which rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


__all__ = ["WORD", "dropped", "materialise", "new_folder", "row_id_fold", "table", "text_or_empty"]
