"""Global row numbers without a single-task sort."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def numbered(rows: DataFrame, *order: str, name: str = "row") -> tuple[DataFrame, int]:
    """rows with their number from 0 in the order of the given columns; and how many there are.

    One range exchange; the numbers within a partition are fixed by writing the sorted partitions once, and only
    one count a partition comes to the driver. Rows that are equal in the given columns follow each other in the
    order in which they were read, so that many of them are cut into several partitions too. Samples of the order
    columns pass through the driver: give a checksum instead of a long text.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("_num_tie", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(parts, *order, "_num_tie").sortWithinPartitions(*order, "_num_tie").drop("_num_tie").withColumn("_num_at", F.monotonically_increasing_id())
    kept = written(ordered.select("*", F.shiftright("_num_at", 33).cast("int").alias("_num_part")), "numbered")
    counts = sorted((r["_num_part"], r["count"]) for r in kept.groupBy("_num_part").count().collect())
    firsts = list(accumulate((c for _, c in counts), initial=0))
    bases = spark.createDataFrame([(p, f) for (p, _), f in zip(counts, firsts)], "_num_part int, _num_base long")
    out = kept.join(F.broadcast(bases), "_num_part").withColumn(name, F.col("_num_base") + F.col("_num_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_num_part", "_num_at", "_num_base"), firsts[-1]


def numbered_within(rows: DataFrame, group: str, *order: str, name: str = "at", size: str = "size") -> DataFrame:
    """rows with their number from 0 within their group, and the group's size.

    Rows are numbered over (group, order) and a group's first number is taken off, so a large group is sorted in
    many tasks. Whether the firsts, one row a group, are sent to all tasks is left to Spark's size check.
    """
    found, _ = numbered(rows, group, *order, name=name)
    groups = found.groupBy(F.col(group).alias("_group")).agg(F.min(name).alias("_first"), F.count(F.lit(1)).alias(size))
    return found.join(groups, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col(name) - F.col("_first")).drop("_first", "_group")
