"""Result tables: shared methods, gaps, shades, ranks and formatted rows. Inputs are small, one row a measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Display labels.
LABELS = {
    "mean": "Mean", "std": "Std", "mean_std": "Mean+Std", "stats": "Stats", "max": "Max", "gem": "GeM", "mean_max": "Mean+Max", "percentiles": "Percentiles",
    "center_weighted_mean": "Center-Weighted", "median_iqr": "Median+IQR", "flattened_cov": "Covariance", "pca_64": "PCA", "bovw_128": "BoVW",
}
EXCLUDED = ("signed_non_cancelling_gem",)
LIGHT, DARK = 5, 45


def shared_methods(results: DataFrame, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Methods that every dataset has, less the excluded ones."""
    n = results.agg(F.countDistinct("dataset").alias("_n"))
    per = results.groupBy("pool").agg(F.countDistinct("dataset").alias("_has"))
    return per.crossJoin(F.broadcast(n)).filter((F.col("_has") == F.col("_n")) & ~F.col("pool").isin(*excluded)).select("pool")


def selected(results: DataFrame, probe: str, methods: DataFrame | None = None) -> DataFrame:
    """The results of a probe, and of the given methods; having none is an error."""
    rows = results.filter(F.col("probe") == probe)
    rows = rows if methods is None else rows.join(F.broadcast(methods), "pool", "left_semi")
    if rows.isEmpty():
        raise ValueError(f"no results of {probe} for these methods")
    return rows


def with_average(results: DataFrame, value: str = "accuracy") -> DataFrame:
    """(dataset, split_type, pool, value) with the mean over the datasets as dataset 'avg'."""
    sets = results.groupingSets([["dataset", "split_type", "pool"], ["split_type", "pool"]], "dataset", "split_type", "pool")
    return sets.agg(F.avg(value).alias("value"), F.grouping("dataset").alias("_g")).select(F.when(F.col("_g") == 1, "avg").otherwise(F.col("dataset")).alias("dataset"), "split_type", "pool", "value")


def gaps(values: DataFrame) -> DataFrame:
    """(dataset, pool, gap): standard less spatial, in points."""
    one = lambda s: F.max(F.when(F.col("split_type") == s, F.col("value")))
    return values.groupBy("dataset", "pool").agg(((one("standard") - one("spatial")) * 100).alias("gap")).filter("gap is not null")


def mean_gaps(values: DataFrame) -> DataFrame:
    """Mean gap over the datasets; incomplete methods are left out."""
    return gaps(values).groupBy("pool").agg(F.avg("gap").alias("gap"), F.count(F.lit(1)).alias("datasets"))


def shaded(rows: DataFrame, value: str, *group: str, low: int = LIGHT, high: int = DARK, inverted: bool = False) -> DataFrame:
    """rows with ``shade``: value rescaled to low..high within its group and rounded; a constant group gets the middle."""
    w = Window.partitionBy(*group)
    a, b, v = F.min(value).over(w), F.max(value).over(w), F.col(value)
    part = (b - v) / (b - a) if inverted else (v - a) / (b - a)
    return rows.withColumn("shade", F.when(b > a, F.bround(low + part * (high - low), 0)).otherwise(F.bround(F.lit((low + high) / 2), 0)).cast("int"))


def best_two(rows: DataFrame, value: str, *group: str, ascending: bool = False) -> DataFrame:
    """rows with ``place`` 1 or 2; ties by the method's name."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(order, "pool"))).filter("place <= 2")


def family(pool: Column) -> Column:
    """0 for training-free methods, 1 for principal components, 2 for visual words."""
    return F.when(pool.startswith("pca_"), 1).when(pool.startswith("bovw_"), 2).otherwise(0)


def report_order(values: DataFrame) -> DataFrame:
    """(pool, ord): training-free methods first, each family by its spatial average."""
    avg = values.filter("dataset = 'avg' and split_type = 'spatial'")
    return avg.select("pool", F.row_number().over(Window.orderBy(family(F.col("pool")), "value", "pool")).alias("ord"))


def label(pool: Column) -> Column:
    """Display label; others with underscores as blanks."""
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, pool), F.replace(pool, F.lit("_"), F.lit(" ")))


def tenths(value: Column) -> Column:
    """A percentage with one decimal as text, without thousands separators."""
    return F.format_string("%.1f", F.round(value, 1))


def report_rows(values: DataFrame) -> DataFrame:
    """(ord, line): one text row a method: label and spatial values by dataset, best **, second *."""
    spatial = values.filter("split_type = 'spatial'")
    marks = best_two(spatial, "value", "dataset").select("dataset", "pool", "place")
    cell = F.concat(tenths(F.col("value") * 100), F.when(F.col("place") == 1, "**").when(F.col("place") == 2, "*").otherwise(""))
    cells = spatial.join(marks, ["dataset", "pool"], "left").select("pool", "dataset", cell.alias("cell"))
    lines = cells.groupBy("pool").agg(F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.struct("dataset", "cell"))), lambda s: s["cell"])).alias("cells"))
    return lines.join(report_order(values), "pool").select("ord", F.concat_ws(" | ", label(F.col("pool")), "cells").alias("line"))


def axis_range(values: DataFrame) -> DataFrame:
    """(low, high) of an axis in points: five below the least, at most 60; five above the most, at least 100."""
    v = F.col("value") * 100
    return values.agg(F.least(F.min(v) - 5, F.lit(60.0)).alias("low"), F.greatest(F.max(v) + 5, F.lit(100.0)).alias("high"))


def density(rows: DataFrame, value: str, group: str, bins: int = 40) -> DataFrame:
    """(group, bin, density): a histogram of unit area over the value's range; the last bin is closed. A range of one
    value is widened by a half on both sides."""
    wide = F.when(F.min(value) == F.max(value), 0.5).otherwise(0.0)
    ends = rows.agg((F.min(value) - wide).alias("_a"), (F.max(value) + wide).alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    placed = rows.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.floor((F.col(value) - F.col("_a")) / width), F.lit(bins - 1)).cast("int")).withColumn("_w", width)
    totals = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    counts = placed.groupBy(group, "bin").agg(F.count(F.lit(1)).alias("n"), F.max("_w").alias("_w")).join(totals, group)
    return counts.select(group, "bin", (F.col("n") / (F.col("_n") * F.col("_w"))).alias("density"))
