"""Seeded, partition-independent sampling: exact stratified quotas, subsamples, bootstraps.

Draws come from the first 32 bits of an md5 of the seed and the keys, so that any engine gives the same rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .order import numbered, numbered_within

#: Rows of a sample up to which a class's candidates are ranked by a window; larger samples are numbered by ranges.
FEW = 100_000
#: A segment's rows (as a power of two) and repetitions whose draws a task holds at a time.
SEGMENT_BITS, REPS_AT_ONCE = 16, 32


def seeded_hash(seed: int, *parts: str | Column) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def quotas(rows: DataFrame, n: int, label: str = "label") -> DataFrame:
    """(label, size, quota): shares of n rounded half to even, the rest spread over classes by size, at least 1, at most the class.

    The windows run over one row a class.
    """
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    everything = Window.partitionBy()
    base = sizes.withColumn("total", F.sum("size").over(everything)).withColumn("base", F.bround(F.col("size") / F.col("total") * n, 0).cast("bigint"))
    base = base.withColumn("rest", n - F.sum("base").over(everything)).withColumn("classes", F.count(F.lit(1)).over(everything))
    rank = F.row_number().over(Window.orderBy(F.col("size").desc(), F.col(label).desc())) - 1
    extra = F.signum("rest").cast("bigint") * (F.expr("abs(rest) div classes") + (rank < F.abs("rest") % F.col("classes")).cast("bigint"))
    quota = F.least(F.greatest(F.col("base") + extra, F.lit(1)), F.col("size"))
    return base.withColumn("quota", quota).select(label, "size", F.when(F.col("total") <= n, F.col("size")).otherwise(F.col("quota")).alias("quota"))


def _bounds(rows: DataFrame, sizes: list[int], seed: int, label: str, key: str) -> DataFrame | None:
    """(label, bound): in every class at least as many hashes are below the bound as the largest quota asks for.

    Hashes are uniform, so the bound that a quota needs is known but for chance; a margin of eight deviations covers it, and a
    count says whether it does. None: it does not, and every row may be needed. One row a class comes to the driver.
    """
    quota = quotas(rows, max(sizes), label)
    margin = F.col("quota") + 8 * F.sqrt("quota") + 16
    bounds = quota.select(F.col(label).alias("_label"), "quota", F.ceil(F.least(margin / F.col("size"), F.lit(1.0)) * (1 << 32)).cast("long").alias("_bound"))
    found = rows.select(label, seeded_hash(seed, key).alias("_hash")).join(F.broadcast(bounds), F.col(label).eqNullSafe(F.col("_label")))
    short = found.groupBy("_label").agg(F.sum((F.col("_hash") < F.col("_bound")).cast("long")).alias("n"), F.max("quota").alias("quota")).filter("n < quota")
    return bounds.select("_label", "_bound") if short.isEmpty() else None


def _ranked(rows: DataFrame, sizes: list[int], seed: int, label: str, key: str) -> DataFrame:
    """rows with ``_at``: their place from 0 in their class in the order of a seeded hash of the key; at least those that samples of
    the given sizes take. Only rows below a bound of the hash, little more than are wanted, are sorted."""
    hashed, bounds = rows.withColumn("_hash", seeded_hash(seed, key)), _bounds(rows, sizes, seed, label, key)
    if bounds is not None:
        hashed = hashed.join(F.broadcast(bounds), F.col(label).eqNullSafe(F.col("_label"))).filter("_hash < _bound").drop("_label", "_bound")
    if bounds is not None and max(sizes) <= FEW:
        # No task gets more than the wanted rows and their margin.
        placed = hashed.withColumn("_at", F.row_number().over(Window.partitionBy(label).orderBy("_hash", key)) - 1)
        return placed.drop("_hash")
    return numbered_within(hashed, label, "_hash", key, name="_at", size="_size").drop("_hash", "_size")


def _cut(ranked: DataFrame, rows: DataFrame, n: int, label: str) -> DataFrame:
    """Of every class the first rows, as many as its quota."""
    quota = F.broadcast(quotas(rows, n, label).select(F.col(label).alias("_label"), "quota"))
    return ranked.join(quota, F.col(label).eqNullSafe(F.col("_label"))).filter(F.col("_at") < F.col("quota")).select(*rows.columns)


def subsample(rows: DataFrame, n: int, seed: int = 42, label: str = "label", key: str = "row_id") -> DataFrame:
    """Exactly the quotas of each class, without replacement. Classes are one row each; their rows are never sorted as a whole."""
    return _cut(_ranked(rows, [n], seed, label, key), rows, n, label)


def bootstrap(rows: DataFrame, reps: int, seed: int = 42, label: str = "label", key: str = "row_id") -> DataFrame:
    """(rep, key, mult): how often each row is drawn when every class is redrawn to its own size with replacement.

    Each row stands for one draw of each repetition, so draws are made where the rows are.
    """
    placed = numbered_within(rows.select(label, key), label, key, name="_at", size="_n")
    return _picked(placed, reps, seed, label).join(placed.select(label, key, "_at"), [label, "_at"]).select("rep", key, label, "mult")


def bootstrap_counts(rows: DataFrame, reps: int, seed: int = 42, label: str = "label", key: str = "row_id") -> DataFrame:
    """(key, label, mult): the draws of ``bootstrap``, each row once with an array of how often every repetition drew it; rows that none drew are left out."""
    placed = numbered_within(rows.select(label, key), label, key, name="_at", size="_n")
    counts = _picked(placed, reps, seed, label).groupBy(label, "_at").agg(F.map_from_entries(F.collect_list(F.struct("rep", "mult"))).alias("_m"))
    mult = F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: F.coalesce(F.try_element_at("_m", r), F.lit(0)).cast("int"))
    return placed.select(label, key, "_at").join(counts, [label, "_at"]).select(key, label, mult.alias("mult"))


def _picked(placed: DataFrame, reps: int, seed: int, label: str) -> DataFrame:
    """(rep, label, _at, mult): the draws, counted. They are exchanged once, by the row drawn, whatever is counted or joined after."""
    draws = placed.select("_n", label, F.col("_at").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    picked = draws.select("rep", label, F.pmod(seeded_hash(seed, "rep", label, "draw"), F.col("_n")).alias("_at"))
    return picked.repartition(label, "_at").groupBy("rep", label, "_at").agg(F.count(F.lit(1)).alias("mult"))


def shared_draws(sizes: np.ndarray, draws: int, at: int, *seed: int) -> int:
    """How many of a class's draws fall to one of its segments: seeded binomials on the way down a binary tree of segments.

    Every node of the tree has a seed of its own, so that each segment finds its share alone, and all shares together are one multinomial draw.
    """
    before = np.r_[0, np.cumsum(sizes)]
    low, high = 0, len(sizes)
    while high - low > 1 and draws:
        middle = (low + high) // 2
        left = np.random.default_rng([*seed, low, high]).binomial(draws, (before[middle] - before[low]) / (before[high] - before[low]))
        low, high, draws = (low, middle, left) if at < middle else (middle, high, draws - left)
    return int(draws)


def bootstrap_in_place(rows: DataFrame, reps: int, seed: int = 42, label: str = "label", key: str = "row_id") -> DataFrame:
    """(rep, key, label, mult): every class redrawn to its own size with replacement, drawn where the rows are.

    Rows are written once, each partition sorted by class, and cut into segments of 65,536. Only the segments' sizes by class come to
    the driver and go to the tasks (one number a segment and class); a segment's share of each repetition's draws follows from the seed
    (``shared_draws``), and its rows are drawn within it. Nothing is exchanged, and a task that is run again draws the same. The
    draws depend on the seed and on how rows are dealt to partitions; ``bootstrap`` gives the same draws for any partitions. A row of a
    null class is one of a class of its own; rows that are never drawn have no row in a repetition.
    """
    spark = rows.sparkSession
    placed = rows.select(F.col(label).alias("label"), F.col(key).alias("key")).sortWithinPartitions("label", "key").withColumn("at", F.monotonically_increasing_id())
    kept = written(placed.withColumn("segment", F.shiftright("at", SEGMENT_BITS)), "drawn-from")
    found: dict = {}
    for r in kept.groupBy("label", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).collect():
        found.setdefault(r["label"], []).append((r["segment"], r["n"], r["first"]))
    names = sorted(found, key=lambda c: (c is not None, c))
    classes = {c: (i, *map(np.array, zip(*sorted(found[c])))) for i, c in enumerate(names)}
    sent = spark.sparkContext.broadcast(classes)

    def draw(batches):
        for batch in batches:
            own = batch["label"].astype(object).where(batch["label"].notna(), None)
            for (name, segment), some in batch.assign(label=own).groupby(["label", "segment"], sort=False, dropna=False):
                number, segments, sizes, firsts = sent.value[None if pd.isna(name) else name]
                at = int(np.searchsorted(segments, segment))
                places, n = (some["at"] - firsts[at]).to_numpy(), int(sizes[at])
                for low in range(0, reps, REPS_AT_ONCE):
                    some_reps = range(low, min(reps, low + REPS_AT_ONCE))
                    mult = np.empty((len(some_reps), len(some)), np.int64)
                    for i, rep in enumerate(some_reps):
                        drawn = shared_draws(sizes, int(sizes.sum()), at, seed, rep, number)
                        mult[i] = np.bincount(np.random.default_rng([seed, rep, number, at]).integers(0, n, drawn), minlength=n)[places]
                    which, row = np.nonzero(mult)
                    yield pd.DataFrame({"rep": which + low, "key": some["key"].to_numpy()[row], "label": some["label"].to_numpy()[row], "mult": mult[which, row]})

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    out = kept.mapInPandas(draw, f"rep int, key {kinds['key']}, label {kinds['label']}, mult long")
    return out.withColumnsRenamed({"key": key, "label": label})


def in_seeded_order(rows: DataFrame, seed: int = 42, key: str = "row_id") -> DataFrame:
    """rows with ``ord``: their place in a seeded shuffle."""
    hashed = rows.withColumn("_hash", seeded_hash(seed, key))
    return numbered(hashed, "_hash", key, name="ord")[0].withColumn("ord", F.col("ord") + 1).drop("_hash")


def size_curve(rows: DataFrame, sizes: list[int], seed: int = 42, label: str = "label", key: str = "row_id") -> DataFrame:
    """Subsamples of several sizes with their ``n_train``; -1 keeps all. Rows are ranked once for all sizes."""
    ranked = _ranked(rows, [n for n in sizes if n != -1], seed, label, key) if any(n != -1 for n in sizes) else rows
    parts = [(rows if n == -1 else _cut(ranked, rows, n, label)).withColumn("n_train", F.lit(n)) for n in sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
