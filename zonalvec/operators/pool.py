"""Training-free pooling of embedding grids as grouped aggregation.

A pooler is a list of blocks; each block is one aggregate over a patch's pixels of one band. The result is
block-major: all bands of the first block, then all of the second. Poolers share one scan and one shuffle on
(patch, band), which partial aggregation keeps small; only exact percentiles keep a group's distinct values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import assemble

V = "v"
#: Values of moments that a task holds before it sends them on, and parts of a patch that are merged first.
HELD_VALUES, SALTS = 4_000_000, 32
#: States of a caller's pooler that are stacked for one merge.
MERGED_AT_ONCE = 256
#: Pixels of a patch in a batch from which on they have a matrix product of their own; products held at a time.
DENSE, PRODUCTS = 64, 4_000_000
PERCENTILES = (10, 25, 50, 75, 90)
QUARTILES = (0.25, 0.5, 0.75)
P, EPS = 3.0, 1e-6


def _nan_if_any(value: Column) -> Column:
    """NumPy's rule: one NaN makes the result NaN. Spark's min and percentile would rank NaN last."""
    return F.when(F.max(F.isnan(V)), F.lit(float("nan"))).otherwise(value)


def least() -> Column:
    return _nan_if_any(F.min(V))


def percentile(q: float, of: tuple[float, ...] | None = None) -> Column:
    """One of several percentiles (shares of 1). Blocks that name the same ones share one aggregate and its values."""
    of = of or (q,)
    return _nan_if_any(F.percentile(V, F.array(*map(F.lit, of)))[of.index(q)])


def _positive(p: float) -> float:
    if p <= 0:
        raise ValueError("p must be positive")
    return p


def power_mean(p: float = P) -> Column:
    """Mean of sign(v)|v|^p, and its signed p-th root."""
    m = F.avg(F.signum(V) * F.pow(F.abs(F.col(V)), F.lit(_positive(p))))
    return F.signum(m) * F.pow(F.abs(m), F.lit(1.0 / p))


def half_power_mean(sign: int, p: float = P, eps: float = EPS) -> Column:
    """p-mean of one sign's part, floored at eps before the power."""
    return F.pow(F.avg(F.pow(F.greatest(sign * F.col(V), F.lit(eps)), F.lit(_positive(p)))), F.lit(1.0 / p))


def centre_mean(sigma: float | None = None) -> Column:
    """Mean under a Gaussian around the grid's centre; sigma is a quarter of the shorter side unless given."""
    s = F.least("h", "w") / 4.0 if sigma is None else F.lit(float(sigma))
    far = F.pow(F.col("x") - (F.col("w") - 1) / 2.0, F.lit(2)) + F.pow(F.col("y") - (F.col("h") - 1) / 2.0, F.lit(2))
    weight = F.exp(-far / (2 * s * s))
    return F.sum(weight * F.col(V)) / F.sum(weight)


@dataclass(frozen=True)
class Pooler:
    """blocks: aggregates over one band, in the order of the output."""

    name: str
    blocks: tuple[Callable[[], Column], ...]

    def dim(self, d: int) -> int:
        return len(self.blocks) * d

    def columns(self) -> list[Column]:
        return [b() for b in self.blocks]


def percentiles(of: Iterable[float] = PERCENTILES, accuracy: int | None = None) -> Pooler:
    """Exact with interpolation; with ``accuracy`` values of the zone whose rank is off by 1 / accuracy of its size at most,
    from a sketch of bounded size, for very large zones."""
    shares = tuple(q / 100.0 for q in of)
    if accuracy:
        sketch = lambda: F.percentile_approx(V, F.array(*map(F.lit, shares)), accuracy)
        return Pooler("percentiles_approx", tuple((lambda i=i: _nan_if_any(sketch()[i])) for i in range(len(shares))))
    return Pooler("percentiles", tuple((lambda q=q: percentile(q, shares)) for q in shares))


def gem(p: float = P) -> Pooler:
    _positive(p)
    return Pooler("gem", (lambda: power_mean(p),))


def signed_gem(p: float = P, eps: float = EPS) -> Pooler:
    _positive(p)
    return Pooler("signed_non_cancelling_gem", (lambda: half_power_mean(1, p, eps), lambda: half_power_mean(-1, p, eps)))


def centre_weighted(sigma: float | None = None) -> Pooler:
    return Pooler("center_weighted_mean", (lambda: centre_mean(sigma),))


def _mean() -> Column:
    return F.avg(V)


def _std() -> Column:
    return F.stddev_pop(V)


def _max() -> Column:
    return F.max(V)


#: name -> pooler. Covariance has a form of its own, see ``covariance``.
POOLERS: dict[str, Pooler] = {
    p.name: p
    for p in (
        Pooler("mean", (_mean,)), Pooler("std", (_std,)), Pooler("mean_std", (_mean, _std)), Pooler("stats", (least, _max, _mean, _std)), Pooler("max", (_max,)),
        gem(), signed_gem(), Pooler("mean_max", (_mean, _max)), percentiles(), centre_weighted(),
        Pooler("median_iqr", (lambda: percentile(0.5, QUARTILES), lambda: percentile(0.75, QUARTILES) - percentile(0.25, QUARTILES))), Pooler("min", (least,)),
    )
}
COVARIANCE = "flattened_cov"
FITTED = {"pca_64": 64, "bovw_128": 128}
TRAINING_FREE = [n for n in POOLERS if n != "min"] + [COVARIANCE]


def output_dim(method: str, d: int = 64) -> int:
    """Width of a method's vectors for inputs of d bands; unknown methods fail."""
    if method in POOLERS:
        return POOLERS[method].dim(d)
    if method == COVARIANCE:
        return d * (d + 1) // 2
    kind, _, width = method.partition("_")
    if kind in ("pca", "bovw") and width.isdigit():
        return int(width)
    raise ValueError(f"unknown method: {method}")


def pool_long(rows: DataFrame, pooler: Pooler, keys: tuple[str, ...] = ("patch_id",)) -> DataFrame:
    """Long rows -> (keys, ord, value)."""
    return pool_many(rows, [pooler], keys).drop("method")


def pool_many(rows: DataFrame, poolers: Iterable[Pooler], keys: tuple[str, ...] = ("patch_id",)) -> DataFrame:
    """Several methods from one scan and one shuffle: (method, keys, ord, value). Equal aggregates are computed once by Catalyst."""
    poolers = list(poolers)
    named = [(p.name, i, f"_{k}_{i}", c) for k, p in enumerate(poolers) for i, c in enumerate(p.columns())]
    stats = rows.groupBy(*keys, "band").agg(F.max("d").alias("_d"), *[c.alias(n) for _, _, n, c in named])
    cells = F.array(*[F.struct(F.lit(m).alias("method"), (F.lit(i) * F.col("_d") + F.col("band")).cast("int").alias("ord"), F.col(n).cast("double").alias("value")) for m, i, n, _ in named])
    return stats.select(*keys, F.explode(cells).alias("_c")).select("_c.method", *keys, "_c.ord", "_c.value")


def covariance(pixels: DataFrame, denom_floor: bool = False) -> DataFrame:
    """Pixel rows (patch_id, vec) -> (patch_id, ord, value): upper triangle of the sample covariance, diagonal included, row-major.

    One pixel gives NaN, or 0 with denom_floor (the divisor is then at least 1); a NaN or null value makes its bands' entries NaN.
    Each task sums up its own pixels of a patch as (n, mean, products of the deviations from that mean); the parts of a
    patch are merged in two steps by the rule for shifted means, so that no one task gets all parts of a large patch, no pixel
    is exploded or read twice, and large means cancel nothing. Batches are sorted by patch, and all their patches are summed up
    at once as segments; only patches of many pixels in a batch have a matrix product of their own.
    """

    return covariance_cells(merged_moments(pixel_moments(pixels)), denom_floor)


MOMENTS = "patch_id long, n long, mean array<double>, xx array<double>"


def pixel_moments(pixels: DataFrame) -> DataFrame:
    """(patch_id, n, mean, products of the deviations) of each task's own pixels of a patch, before any exchange."""

    def moments(batches):
        held: list[tuple] = []
        for batch in batches:
            if len(batch):
                held.append(_pixel_moments(batch["patch_id"].to_numpy(), np.stack(batch["vec"].to_numpy()).astype(float)))
                held = _settled(held, HELD_VALUES)
                if len(held) == 1 and held[0][3].size > HELD_VALUES:
                    yield _frame(held[0])
                    held = []
        if held:
            yield _frame(_merged(held))

    return pixels.select(F.col("patch_id").cast("long").alias("patch_id"), "vec").mapInPandas(moments, MOMENTS)


def merged_moments(parts: DataFrame) -> DataFrame:
    """One row a patch from any number of parts: merged moments can be kept, and merged with later ones."""

    def merge(batches):
        held: list[tuple] = []
        for batch in batches:
            if len(batch):
                held = _settled([*held, tuple(np.stack(batch[c].to_numpy()) if c in ("mean", "xx") else batch[c].to_numpy() for c in ("patch_id", "n", "mean", "xx"))], HELD_VALUES)
                if len(held) == 1 and held[0][3].size > HELD_VALUES:  # patches come in order: all but the last are whole
                    yield _frame(tuple(x[:-1] for x in held[0]))
                    held = [tuple(x[-1:] for x in held[0])]
        if held:
            yield _frame(_merged(held))

    return in_two_steps(parts, lambda rows, _: rows.select("patch_id", "n", "mean", "xx").mapInPandas(merge, MOMENTS))


def in_two_steps(parts: DataFrame, merge: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """parts (patch_id, ...) merged by (patch, salt) and then by patch, each time in the order of patches, so that no one task gets all
    parts of a large patch. ``merge`` is told whether the step is the last."""
    for keys in (("patch_id", F.pmod(F.spark_partition_id(), F.lit(SALTS))), ("patch_id",)):
        salted = parts.select("*", *[k.alias("_salt") for k in keys[1:]])
        names = ["patch_id", "_salt"][: len(keys)]
        parts = merge(salted.repartition(*names).sortWithinPartitions(*reversed(names)), len(keys) == 1)
    return parts


def covariance_cells(whole: DataFrame, denom_floor: bool = False) -> DataFrame:
    """(patch_id, ord, value) of merged moments: see ``covariance``."""
    alone = F.lit(0.0 if denom_floor else float("nan"))
    d = F.size("mean")
    cells = F.expr("flatten(transform(sequence(0, size(mean) - 1), i -> slice(xx, i * size(mean) + i + 1, size(mean) - i)))")
    return whole.select("patch_id", "n", F.posexplode(F.when(d > 0, cells)).alias("ord", "s")).select("patch_id", "ord", F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)).otherwise(alone).alias("value"))


def _segments(patches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal patches together, the patches, and where each begins."""
    order = np.argsort(patches, kind="stable")
    found, first = np.unique(patches[order], return_index=True)
    return order, found, first


def _outer(x: np.ndarray) -> np.ndarray:
    return (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)


def _pixel_moments(patches: np.ndarray, x: np.ndarray) -> tuple:
    """(patches, n, mean, products of the deviations) of a batch's pixels."""
    order, found, first = _segments(patches)
    x, d = x[order], x.shape[1]
    n = np.diff(np.r_[first, len(x)])
    mean = np.add.reduceat(x, first, axis=0) / n[:, None]
    x = x - np.repeat(mean, n, axis=0)
    products = np.empty((len(found), d * d))
    large = n >= DENSE
    for k in np.flatnonzero(large):
        own = x[first[k] : first[k] + n[k]]
        products[k] = (own.T @ own).ravel()
    rest = np.flatnonzero(~large)
    step = max(1, PRODUCTS // (d * d * DENSE))
    for at in range(0, len(rest), step):
        some = rest[at : at + step]
        rows = np.repeat(first[some] - np.r_[0, np.cumsum(n[some])[:-1]], n[some]) + np.arange(n[some].sum())
        products[some] = np.add.reduceat(_outer(x[rows]), np.r_[0, np.cumsum(n[some])[:-1]], axis=0)
    return found, n, mean, products


def _merged(parts: list[tuple]) -> tuple:
    """Moments (patches, n, mean, products) of several parts, one row a patch in ascending order: the rule for shifted means, for all patches at once."""
    patches, n, mean, products = (np.concatenate(x) for x in zip(*parts))
    order, found, first = _segments(patches)
    n, mean, products = n[order], mean[order], products[order]
    count = np.add.reduceat(n, first)
    middle = np.add.reduceat(mean * n[:, None], first, axis=0) / count[:, None]
    apart = (mean - np.repeat(middle, np.diff(np.r_[first, len(n)]), axis=0)) * np.sqrt(n)[:, None]
    out = np.add.reduceat(products, first, axis=0)
    step = max(1, PRODUCTS // mean.shape[1] ** 2)
    owner = np.repeat(np.arange(len(found)), np.diff(np.r_[first, len(n)]))
    for at in range(0, len(n), step):
        some = owner[at : at + step]
        heads = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
        out[some[heads]] += np.add.reduceat(_outer(apart[at : at + step]), heads, axis=0)
    return found, count, middle, out


def _settled(held: list[tuple], most: int) -> list[tuple]:
    """The parts, merged where together they hold more than ``most`` values."""
    return [_merged(held)] if sum(h[3].size for h in held) > most else held


def _frame(part: tuple) -> pd.DataFrame:
    found, n, mean, products = part
    return pd.DataFrame({"patch_id": found, "n": n, "mean": list(mean), "xx": list(products)})


def covariance_by_pairs(pixels: DataFrame, denom_floor: bool = False, keys: tuple[str, ...] = ("patch_id",)) -> DataFrame:
    """The same without Python: pairs of bands are exploded from each pixel, d(d+1)/2 rows each, and summed with partial
    aggregation. For pixels of a few bands, and for keys of any kind."""
    pairs = F.explode(F.expr("flatten(transform(sequence(0, size(vec) - 1), i -> transform(sequence(i, size(vec) - 1), j -> struct(i, j, cast(vec[i] as double) as a, cast(vec[j] as double) as b))))"))
    rows = pixels.select(*keys, F.size("vec").alias("_d"), pairs.alias("p")).select(*keys, "_d", "p.i", "p.j", "p.a", "p.b")
    cov = rows.groupBy(*keys, "_d", "i", "j").agg(F.covar_samp("a", "b").alias("value"))
    value = F.coalesce("value", F.lit(0.0 if denom_floor else float("nan")))
    return cov.select(*keys, (F.col("i") * F.col("_d") - F.expr("i * (i - 1) div 2") + F.col("j") - F.col("i")).cast("int").alias("ord"), value.alias("value"))


def average_deviation(rows: DataFrame) -> DataFrame:
    """Mean over the bands of each band's deviation between pixels: (patch_id, value)."""
    return rows.groupBy("patch_id", "band").agg(F.stddev_pop(V).alias("s")).groupBy("patch_id").agg(F.avg("s").alias("value"))


def custom(pixels: DataFrame, function: Callable, d_out: int) -> DataFrame:
    """A caller's function of a patch's (pixels, bands) array, run per patch in pandas: (patch_id, features)."""
    def run(key, frame):
        frame = frame.sort_values(["y", "x"])
        out = np.asarray(function(np.stack(frame["vec"].to_numpy()).astype(float)), float)
        if out.shape != (d_out,):
            raise ValueError(f"the pool function gave shape {out.shape}, not ({d_out},)")
        return pd.DataFrame({"patch_id": [key[0]], "features": [out]})

    return pixels.groupBy("patch_id").applyInPandas(run, "patch_id long, features array<double>")


@dataclass(frozen=True)
class Mergeable:
    """A caller's pooler whose states merge. update: pixels (n, bands) -> the state of these alone, a vector; merge: states (m, width) -> one
    state; finish: state -> d_out values. The pixels of a patch come in any order and in any parts."""

    update: Callable[[np.ndarray], np.ndarray]
    merge: Callable[[np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], np.ndarray]
    d_out: int


def custom_mergeable(pixels: DataFrame, pooler: Mergeable) -> DataFrame:
    """A caller's mergeable pooler: (patch_id, features). Every task makes states of its own pixels, and states are merged in two steps,
    so that a patch of any size is spread over tasks and none holds its pixels. A state that isn't a vector, or a result that
    hasn't d_out values, is an error; a patch whose vectors are all null has no row."""
    state = "patch_id long, state array<double>"

    def one(values) -> np.ndarray:
        out = np.asarray(values, float)
        if out.ndim != 1:
            raise ValueError(f"a state of shape {out.shape}, not a vector")
        return out

    def frame(states: dict[int, list[np.ndarray]]) -> pd.DataFrame:
        return pd.DataFrame({"patch_id": list(states), "state": [one(s[0] if len(s) == 1 else pooler.merge(np.stack(s))) for s in states.values()]})

    def updated(batches):
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            batch = batch[batch["vec"].notna()]
            if len(batch):
                order, found, first = _segments(batch["patch_id"].to_numpy())
                x = np.stack(batch["vec"].to_numpy()).astype(float)[order]
                for patch, own in zip(found, np.split(x, first[1:])):
                    held.setdefault(int(patch), []).append(one(pooler.update(own)))
                    size += held[int(patch)][-1].size
            if size > HELD_VALUES:
                yield frame(held)
                held, size = {}, 0
        if held:
            yield frame(held)

    def merged(batches):
        patch, states = None, []
        for batch in batches:
            done: dict[int, list[np.ndarray]] = {}
            for p, s in zip(batch["patch_id"].to_numpy(), batch["state"]):
                if p != patch and states:
                    done.setdefault(int(patch), []).extend(states)
                    states = []
                patch = p
                states.append(np.asarray(s, float))
                if len(states) == MERGED_AT_ONCE:
                    states = [one(pooler.merge(np.stack(states)))]
            if done:
                yield frame(done)
        if states:
            yield frame({int(patch): states})

    def finished(batches):
        for batch in batches:
            found = [np.asarray(pooler.finish(np.asarray(s, float)), float) for s in batch["state"]]
            for out in found:
                if out.shape != (pooler.d_out,):
                    raise ValueError(f"the pool function gave shape {out.shape}, not ({pooler.d_out},)")
            yield pd.DataFrame({"patch_id": batch["patch_id"], "features": found})

    def step(rows: DataFrame, _: bool) -> DataFrame:
        # Sorted by (salt, patch): equal patches of two salts may meet, which is as good.
        return rows.select("patch_id", "state").mapInPandas(merged, state)

    parts = pixels.select(F.col("patch_id").cast("long").alias("patch_id"), "vec").mapInPandas(updated, state)
    return in_two_steps(parts, step).mapInPandas(finished, "patch_id long, features array<double>")


def features(rows: DataFrame, method: str) -> DataFrame:
    """(patch_id, features) of a training-free method from long rows."""
    return assemble(pool_long(rows, POOLERS[method]), "patch_id")
