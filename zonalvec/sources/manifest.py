"""Split manifests, the class dictionary, loading with quarantine, and routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's text lines: (line, ord) with a number that grows within a file."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("ord"))


def parsed(lines: DataFrame) -> DataFrame:
    """(ord, rel_path, class_name, error): trimmed, blanks skipped, every .jpg removed, class before the last underscore.

    A line without an underscore has an error instead of a path.
    """
    stem = F.replace(F.trim("line"), F.lit(".jpg"), F.lit(""))
    rows = lines.filter(F.trim("line") != "").withColumn("_stem", stem)
    rows = rows.withColumn("_cut", F.length("_stem") - F.locate("_", F.reverse("_stem")) + 1).withColumn("_ok", F.col("_stem").contains("_"))
    name = F.substring(F.col("_stem"), F.lit(1), (F.col("_cut") - 1).cast("int"))
    return rows.select(
        "ord", F.when(F.col("_ok"), F.concat(name, F.lit("/"), "_stem")).alias("rel_path"), F.when(F.col("_ok"), name).alias("class_name"),
        F.when(~F.col("_ok"), F.concat(F.lit("no class in "), "_stem")).alias("error"),
    )


def entries(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(ord, rel_path, class_name); strict fails on a line without a class, otherwise see ``rejected``."""
    rows = parsed(lines)
    if strict:
        rows = rows.withColumn("rel_path", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("rel_path")))
        return rows.drop("error")
    return rows.filter("error is null").drop("error")


def rejected(lines: DataFrame) -> DataFrame:
    return parsed(lines).filter("error is not null").select("ord", "error")


SPLITS = ("standard", "spatial")
ROLES = ("train", "val", "test")


def split(rows: DataFrame, split_type: str, role: str) -> DataFrame:
    """Rows of one split; with the split columns as partition columns this prunes files."""
    if split_type not in SPLITS or role not in ROLES:
        raise ValueError(f"unknown split: {split_type} {role}")
    return rows.filter((F.col("split_type") == split_type) & (F.col("role") == role))


def encode_labels(rows: DataFrame, classes: DataFrame, strict: bool = True) -> DataFrame:
    """rows with ``label``, the class's number; the dictionary is small and Spark broadcasts it by its size."""
    known = rows.join(classes.select("class_name", F.col("idx").alias("label")), "class_name", "left")
    if not strict:
        return known
    return known.withColumn("label", F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("unknown class: "), F.col("class_name")))).otherwise(F.col("label")))


def decode_labels(rows: DataFrame, classes: DataFrame, strict: bool = True) -> DataFrame:
    """rows with ``class_name``; a number that the dictionary lacks fails when its row is read. Not strict: its name is null."""
    named = rows.join(classes.select("class_name", F.col("idx").alias("label")), "label", "left")
    if not strict:
        return named
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col("label").cast("string"), F.lit("null"))))
    return named.withColumn("class_name", F.when(F.col("class_name").isNull(), unknown).otherwise(F.col("class_name")))


def unknown_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes, "class_name", "left_anti").select("class_name").distinct()


def load(manifest: DataFrame, grids: DataFrame, key: str = "patch_id") -> DataFrame:
    """Manifest entries with their grids; ``ord`` keeps the manifest's order."""
    return manifest.join(grids, key)


def load_pooled(manifest: DataFrame, grids: DataFrame, pool: Callable[[DataFrame], DataFrame], key: str = "patch_id") -> DataFrame:
    """Load and pool: only grids that the manifest names are pooled."""
    wanted = grids.join(manifest.select(key), key, "left_semi")
    return manifest.join(pool(wanted), key)


def lookup(manifest: DataFrame, grids: DataFrame, patch_id: int, key: str = "patch_id") -> DataFrame:
    """One patch with its label; the filter reaches both scans."""
    return load(manifest.filter(F.col(key) == patch_id), grids.filter(F.col(key) == patch_id), key)


def band_first_to_last(rows: DataFrame, pix: str = "pix") -> DataFrame:
    """Grids stored band by band -> long rows."""
    at = rows.select("patch_id", "h", "w", "d", F.posexplode(pix).alias("pos", "v"))
    return at.select(
        "patch_id", F.expr("pos % (h * w) div w").cast("int").alias("y"), F.expr("pos % w").cast("int").alias("x"), F.expr("pos div (h * w)").cast("int").alias("band"),
        F.col("v").cast("double").alias("v"), "h", "w", "d",
    )


def quarantine(rows: DataFrame, checks: dict[str, Column], key: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, (key, error) of the others); the first check that isn't true names the error."""
    error = F.lit(None).cast("string")
    for name, ok in reversed(checks.items()):
        error = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(error)
    judged = rows.withColumn("_error", error)
    return judged.filter("_error is null").drop("_error"), judged.filter("_error is not null").select(F.col(key).alias("key"), F.col("_error").alias("error"))


def class_of_stem(stem: Column) -> Column:
    """The class before the first underscore."""
    return F.substring_index(stem, "_", 1)


def pending(requested: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What is still to do when what is done is skipped."""
    return requested.join(done, list(keys), "left_anti")


def coverage(methods: DataFrame, splits: DataFrame, present: DataFrame, missing: bool) -> DataFrame:
    """The requested grid of methods and splits (a few rows) without, or with, what is present."""
    return methods.crossJoin(splits).join(present.select("pool", "split_type").distinct(), ["pool", "split_type"], "left_anti" if missing else "left_semi")
