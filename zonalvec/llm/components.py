"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _digest(edges: DataFrame) -> tuple:
    """Order-free checksum of an edge table (one row to the driver)."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u > v in every edge, so v are u's smaller neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links between ids -> (u, root): every linked id that isn't its component's least, with that least id.

    Alternating large-star and small-star rounds; each is two partial-aggregated shuffles and a join whose
    second side has one row a key, so a hub is pre-aggregated and its join can be split. Rounds grow with the
    logarithm of the longest path. Loops and repeated edges are allowed; an empty table gives an empty one.
    """
    now = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        now = materialise(_small_star(_large_star(now)), "edges", instead_of=now)
        said = _digest(now)
        if said == seen:
            break
        seen = said
    return now.select("u", F.col("v").alias("root"))
