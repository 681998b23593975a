"""Layouts of embedding grids and the rules for assembling vectors from rows.

Three layouts are used:

* patch rows: ``patch_id, h, w, d, pix`` with ``pix`` an array in (y, x, band) order, for storage;
* pixel rows: ``patch_id, y, x, vec`` with one vector a pixel;
* long rows:  ``patch_id, y, x, band, v`` plus ``h, w, d``, for aggregation. One column a band is never made.

Vectors are assembled by an explicit ordinal, never by the order in which rows happen to arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATCHES = T.StructType(
    [T.StructField("patch_id", T.LongType())] + [T.StructField(c, T.IntegerType()) for c in "hwd"] + [T.StructField("pix", T.ArrayType(T.FloatType()))]
)
LONG_COLUMNS = ("patch_id", "y", "x", "band", "v", "h", "w", "d")


def patches_to_long(patches: DataFrame) -> DataFrame:
    """Patch rows -> long rows; v is a double."""
    rows = patches.select("patch_id", "h", "w", "d", F.posexplode("pix").alias("pos", "v"))
    return rows.select(
        "patch_id", F.expr("pos div (w * d)").cast("int").alias("y"), F.expr("pos div d % w").cast("int").alias("x"), F.expr("pos % d").cast("int").alias("band"),
        F.col("v").cast("double").alias("v"), "h", "w", "d",
    )


def pixels_to_long(pixels: DataFrame, d: int, h: int | None = None, w: int | None = None) -> DataFrame:
    """Pixel rows -> long rows of d bands; h and w where the grid's size is known."""
    rows = pixels.select("patch_id", "y", "x", F.posexplode("vec").alias("band", "v"))
    size = lambda n: F.lit(n).cast("int")
    return rows.select("patch_id", "y", "x", "band", F.col("v").cast("double").alias("v"), size(h).alias("h"), size(w).alias("w"), size(d).alias("d"))


def in_order(position: str | Column, value: str | Column) -> Column:
    """Aggregate: the values as an array in the order of their positions."""
    position, value = (F.col(c) if isinstance(c, str) else c for c in (position, value))
    return F.transform(F.array_sort(F.collect_list(F.struct(position.alias("ord"), value.alias("v")))), lambda s: s["v"])


def assemble(rows: DataFrame, *keys: str) -> DataFrame:
    """Long result rows (keys, ord, value) -> one row a key with ``features``."""
    return rows.groupBy(*keys).agg(in_order("ord", "value").alias("features"))


def check_width(df: DataFrame, column: str, width: int) -> DataFrame:
    """Fail on a vector of another width; the check runs with the query."""
    ok = F.size(column) == width
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.format_string("%s has %d values, not %d", F.lit(column), F.size(column), F.lit(width)))))
