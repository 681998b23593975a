"""Value codecs and cleaning as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantise_power(v: Column, power: float = 2.0, scale: float = 127.5) -> Column:
    """Signed root, scaled, rounded half to even, clamped to +-127 and moved to 0..254."""
    root = F.signum(v) * F.pow(F.abs(v), F.lit(1.0 / power)) * scale
    return (F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.bround(root, 0))) + 127).cast("smallint")


def quantise_offset(v: Column) -> Column:
    """Signed byte to unsigned, by an offset of 128."""
    return (v.cast("int") + 128).cast("smallint")


def recode_u8(v: Column) -> Column:
    """Cast to an unsigned byte; values outside 0..255 fail. SMALLINT, since Spark's BYTE is signed."""
    return F.when(v.between(0, 255), v.cast("smallint")).otherwise(F.raise_error(F.concat(F.lit("outside 0..255: "), v.cast("string"))))


def is_odd(v: Column) -> Column:
    """NaN or infinite."""
    return F.isnan(v) | (F.abs(v) == float("inf"))


def sanitize(vector: Column) -> Column:
    """NaN and infinities become 0."""
    return F.transform(vector, lambda x: F.when(is_odd(x), F.lit(0.0)).otherwise(x.cast("double")))


def odd_values(vector: Column) -> Column:
    """How many values ``sanitize`` changes."""
    return F.size(F.filter(vector, is_odd)).cast("long")


def scale_clip(v: Column, by: float = 2500.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / by))


def minmax_vector(vector: Column, eps: float = 1e-8) -> Column:
    """(x - min) / (max - min + eps); 0 where that divisor is 0, in a constant vector with eps 0."""
    low, high = F.array_min(vector), F.array_max(vector)
    return F.transform(vector, lambda x: F.when(high - low + eps != 0, (x - low) / (high - low + eps)).otherwise(0.0))


def percentile_stretch(rows: DataFrame, low: float = 0.02, high: float = 0.98, keys: tuple[str, ...] = ("patch_id", "band")) -> DataFrame:
    """Long rows -> v scaled so that the two percentiles of its group become 0 and 1, clipped; a flat group becomes 0.

    The percentiles are a grouped aggregate joined back, so that a large group is not held by a window.
    """
    ends = rows.groupBy(*keys).agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("_ends"))
    a, b = F.col("_ends")[0], F.col("_ends")[1]
    scaled = F.when(b > a, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - a) / (b - a)))).otherwise(0.0)
    return rows.join(ends, list(keys)).withColumn("v", scaled).drop("_ends")


def vector_slice(vector: Column, n: int) -> Column:
    return F.slice(vector, 1, n)


def stride_sample(pixels: DataFrame, stride: int, key: str = "patch_id", order: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Every stride-th pixel of each patch in row order, the first included."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return pixels.withColumn("_at", at).filter(F.col("_at") % stride == 0).drop("_at")
