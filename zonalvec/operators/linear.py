"""Multinomial logistic regressions, many at a time.

A model is a set of rows (a part), how often each row of it counts (a weight group: a bootstrap's multiplicities, a fold's zeros and ones),
the weights under which features are standardised, and a penalty C. All models are fitted together: one pass over the rows sums up
the loss and the gradient of every model that has not converged, so 18 models of a cross-validation or 100 resamples take as many passes as the
slowest of them takes steps, not as many as all take together. Tasks hold one block of rows and one gradient a model; gradients are merged in
tasks, and the driver sees one sum a model and takes a step of L-BFGS for each. Steps are taken in coordinates in which a part's features are
uncorrelated: features that go together, as the percentiles of one band do, would make the loss a long valley and cost hundreds of passes.

The objective is the penalty |w|^2 / 2 over standardised features and C times the summed loss; intercepts are free. A class
without weight in a model is never predicted by it.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Rows of a block, and numbers whose sums a task merges.
BLOCK, MERGED = 1024, 32
#: Largest entry of the gradient of the mean loss at which a model is done; relative progress of no more count, and steps of L-BFGS remembered.
TOLERANCE, PROGRESS, MEMORY = 1e-5, 1e-8, 20
MAX_STEPS = 1000
#: Rows a task predicts at a time.
PREDICTED = 512


@dataclass(frozen=True)
class Model:
    part: int
    weight: int
    scaler: int
    c: float


@dataclass
class Fitted:
    """Coefficients over unscaled features: model -> (classes, features), and intercepts; -inf for a class it has not seen."""

    models: list[Model]
    classes: list[int]
    coefficients: list[np.ndarray] = field(default_factory=list)
    intercepts: list[np.ndarray] = field(default_factory=list)
    passes: int = 0


def packed(rows: DataFrame) -> DataFrame:
    """rows (part int, label int, features array<double>, w array<double>) -> blocks of rows of one part, written."""

    def run(batches):
        for batch in batches:
            parts = batch.column(0).to_numpy()
            for part in np.unique(parts):
                at = np.flatnonzero(parts == part)
                for i in range(0, len(at), BLOCK):
                    own = batch.take(pa.array(at[i : i + BLOCK]))
                    x, w = (np.ascontiguousarray(own.column(c).flatten().to_numpy(zero_copy_only=False), float) for c in (2, 3))
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.num_rows]), pa.array([own.column(1).to_numpy().astype(np.int64).tobytes()]), pa.array([x.tobytes()]), pa.array([w.tobytes()])], ["part", "n", "y", "x", "w"])

    kept = rows.select(F.col("part").cast("int"), F.col("label").cast("int"), F.col("features").cast("array<double>"), F.col("w").cast("array<double>"))
    return written(kept.mapInArrow(run, "part int, n long, y binary, x binary, w binary"), "linear-blocks")


def _summed(blocks: DataFrame, of, most: int = MERGED) -> dict[int, np.ndarray]:
    """Sums over all blocks. of(part, y, x, w) gives (number, array) pairs, of ``most`` numbers together; a task holds one array a number, and one a number comes to the driver."""

    def each(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n, y, x, w in zip(*(c.to_pylist() for c in batch.columns)):
                for k, v in of(part, np.frombuffer(y, np.int64), np.frombuffer(x).reshape(n, -1), np.frombuffer(w).reshape(n, -1)):
                    held[k] = held[k] + v if k in held else v
        yield from _sent(held)

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(*(c.to_pylist() for c in batch.columns)):
                held[k] = held[k] + np.frombuffer(v) if k in held else np.frombuffer(v)
        yield from _sent(held)

    parts = min(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // MERGED))
    found = blocks.mapInArrow(each, "k int, v binary").repartition(parts, "k").mapInArrow(merge, "k int, v binary")
    return {r["k"]: np.frombuffer(r["v"]) for r in found.collect()}


def _sent(held):
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.ascontiguousarray(v, float).tobytes() for v in held.values()], pa.binary())], ["k", "v"])


def _scalers(blocks: DataFrame, classes: list[int], parts: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], dict[int, np.ndarray], dict[int, np.ndarray]]:
    """part -> (means, scales) with a row for each weight group, part -> the weight of each class in each group, and part -> the covariance of its rows,
    each counted once (d x d values a part)."""
    plain = _summed(blocks, lambda part, y, x, w: [(part, np.r_[len(x), x.sum(0)])], parts)
    shift = {part: s[1:] / s[0] for part, s in plain.items()}

    def moments(part, y, x, w):
        apart = x - shift[part]
        by = np.stack([w[y == c].sum(0) for c in classes])
        return [(part, np.concatenate([(apart.T @ apart).ravel(), by.ravel(), (w.T @ apart).ravel(), (w.T @ (apart * apart)).ravel()]))]

    scales, weights, together = {}, {}, {}
    for part, s in _summed(blocks, moments, parts).items():
        d = len(shift[part])
        together[part], s = s[: d * d].reshape(d, d) / plain[part][0], s[d * d :]
        groups = len(s) // (len(classes) + 2 * d)
        by, first, second = np.split(s, [len(classes) * groups, (len(classes) + d) * groups])
        by, first, second = by.reshape(-1, groups), first.reshape(groups, d), second.reshape(groups, d)
        n = np.maximum(by.sum(0), 1e-300)[:, None]
        deviation = np.sqrt(np.maximum(second / n - (first / n) ** 2, 0))
        level = np.abs(shift[part]) + np.abs(first / n) + deviation.max(initial=0)
        scales[part] = shift[part] + first / n, np.where(deviation > 1e-12 * level, deviation, 1.0)
        weights[part] = by
    return scales, weights, together


def _axes(covariance: np.ndarray, scale: np.ndarray, penalty: float, classes: int) -> np.ndarray:
    """A triangle T: with coefficients w = v @ T the loss bends about equally in all directions of v. The bend is bounded by the features'
    covariance times the largest product of two probabilities, and the penalty; only the speed depends on how good this guess is."""
    d = len(scale)
    bend = covariance / np.outer(scale, scale) / max(2, classes) + (penalty + 1e-9) * np.eye(d)
    return np.linalg.inv(np.linalg.cholesky(bend))


class _Descent:
    """L-BFGS of one model, fed with the loss and gradient at the point it asks for, both in coordinates of its own: coefficients (classes, features and
    intercept) are ``at`` @ ``axes``."""

    def __init__(self, axes: np.ndarray, classes: int):
        size, self.axes = classes * len(axes), axes
        self.at, self.x = np.zeros(size), None
        self.f, self.g, self.step, self.length, self.still, self.steps, self.done = np.inf, None, None, 1.0, 0, 0, False
        self.pairs: list[tuple[np.ndarray, np.ndarray, float]] = []

    def coefficients(self) -> np.ndarray:
        return self.at.reshape(-1, len(self.axes)) @ self.axes

    def told(self, f: float, slopes: np.ndarray) -> None:
        """Value at ``at``, and slopes by coefficients: go on from there if it is low enough, else try a shorter step."""
        g = (slopes @ self.axes.T).ravel()
        if self.x is not None and not f <= self.f + 1e-4 * self.length * (self.g @ self.step):
            slope = self.length * (self.g @ self.step)
            best = -slope / (2 * (f - self.f - slope)) if np.isfinite(f) else 0.1
            self.length *= min(0.5, max(0.1, best))
            self.done = self.length < 1e-12
            self.at = self.x + self.length * self.step
            return
        if self.x is not None:
            moved, turned = self.at - self.x, g - self.g
            if (bend := moved @ turned) > 1e-14 * (turned @ turned):
                self.pairs = [*self.pairs[-MEMORY + 1 :], (moved, turned, 1 / bend)]
            self.still = self.still + 1 if self.f - f <= PROGRESS * max(abs(f), 1e-3) else 0
        self.x, self.f, self.g, self.steps = self.at, f, g, self.steps + 1
        self.done = np.abs(slopes).max(initial=0) <= TOLERANCE or self.still >= 3 or self.steps > MAX_STEPS
        q, shares = g.copy(), []
        for moved, turned, r in reversed(self.pairs):
            shares.append(r * (moved @ q))
            q -= shares[-1] * turned
        if self.pairs:
            moved, turned, r = self.pairs[-1]
            q /= r * (turned @ turned)
        for (moved, turned, r), share in zip(self.pairs, reversed(shares)):
            q += (share - r * (turned @ q)) * moved
        self.step, self.length = -q, 1.0 if self.pairs else 1 / max(1.0, np.linalg.norm(g))
        self.at = self.x + self.length * self.step


def fit_many(blocks: DataFrame, models: list[Model]) -> Fitted:
    """All models over ``packed`` rows."""
    labels = set().union(*(np.frombuffer(r["y"], np.int64).tolist() for r in _label_blocks(blocks).collect()))
    classes = sorted(labels)
    number = np.array(classes)
    scales, weights, together = _scalers(blocks, classes, len({m.part for m in models}))
    out = Fitted(models, classes, [None] * len(models), [None] * len(models))
    seen = [weights[m.part][:, m.weight] > 0 for m in models]
    total = [weights[m.part][:, m.weight].sum() for m in models]
    scaler = [(scales[m.part][0][m.scaler], scales[m.part][1][m.scaler]) for m in models]
    penalties = [1 / (m.c * n) if n else 1.0 for m, n in zip(models, total)]
    descents = []
    for m, s, (_, scale), penalty in zip(models, seen, scaler, penalties):
        axes = np.eye(len(scale) + 1) * np.sqrt(max(2, s.sum()))  # of the intercept, whose feature is 1
        axes[:-1, :-1] = _axes(together[m.part], scale, penalty, int(s.sum()))
        descents.append(_Descent(axes, int(s.sum())))

    def unscaled(i: int) -> tuple[np.ndarray, np.ndarray]:
        mean, scale = scaler[i]
        own = descents[i].coefficients()
        a = own[:, :-1] / scale
        return a, own[:, -1] - a @ mean

    while active := [i for i, d in enumerate(descents) if not d.done]:
        of_part = defaultdict(list)
        for i in active:
            of_part[models[i].part].append((i, models[i].weight, number[seen[i]], *unscaled(i)))
        sent = blocks.sparkSession.sparkContext.broadcast(dict(of_part))

        def value(part, y, x, w, sent=sent):
            for i, group, own, a, b in sent.value.get(part, ()):
                there = w[:, group] > 0
                if not there.any():
                    continue
                xs, ws, at = (x, w[:, group], y) if there.all() else (x[there], w[there, group], y[there])
                at = np.searchsorted(own, at)
                z = xs @ a.T + b
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                sums = p.sum(1, keepdims=True)
                loss = ws @ (np.log(sums[:, 0]) - z[np.arange(len(z)), at])
                p /= sums
                p[np.arange(len(z)), at] -= 1
                p *= ws[:, None]
                yield i, np.concatenate([[loss], (p.T @ xs).ravel(), p.sum(0)])

        got = _summed(blocks.filter(F.col("part").isin(list(of_part))), value, len(active))  # parts that are done are not read again
        sent.unpersist()
        out.passes += 1
        for i in active:
            mean, scale = scaler[i]
            d, k, penalty = len(mean), int(seen[i].sum()), penalties[i]
            s = got.get(i, np.zeros(1 + k * (d + 1))) / max(total[i], 1e-300)
            ga, gb = s[1 : 1 + k * d].reshape(k, d), s[1 + k * d :]
            own = descents[i].coefficients()
            g = np.hstack([(ga - np.outer(gb, mean)) / scale + penalty * own[:, :-1], gb[:, None]])
            descents[i].told(s[0] + penalty / 2 * (own[:, :-1] ** 2).sum(), g)
    for i, d in enumerate(descents):
        d.at = d.x if d.x is not None else d.at
        a, b = unscaled(i)
        out.coefficients[i], out.intercepts[i] = np.zeros((len(classes), a.shape[1])), np.full(len(classes), -np.inf)
        out.coefficients[i][seen[i]], out.intercepts[i][seen[i]] = a, b
    return out


def _label_blocks(blocks: DataFrame) -> DataFrame:
    """The different labels of each task, as bytes."""

    def run(batches):
        found = np.zeros(0, np.int64)
        for batch in batches:
            found = np.union1d(found, np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()])], ["y"])

    return blocks.select("y").mapInArrow(run, "y binary").distinct()


def predict_many(rows: DataFrame, fitted: Fitted, held_out: bool = False) -> DataFrame:
    """(model, q, y, p) of rows (part, row_id, label, features) under every model of their part; with held_out rows also have w, and
    only models in which a row has no weight predict it."""
    sent = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        mine, classes = defaultdict(list), np.array(sent.value.classes, np.int32)
        for i, m in enumerate(sent.value.models):
            mine[m.part].append((i, m.weight, sent.value.coefficients[i], sent.value.intercepts[i]))
        for batch in batches:
            for first in range(0, batch.num_rows, PREDICTED):
                some = batch.slice(first, PREDICTED)
                parts = some.column(0).to_numpy()
                for part in np.unique(parts):
                    own = some.take(pa.array(np.flatnonzero(parts == part)))
                    x = own.column(3).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                    w = own.column(4).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1) if held_out else None
                    q, y = own.column(1).to_numpy(), own.column(2).to_numpy()
                    for i, group, a, b in mine[part]:
                        at = np.flatnonzero(w[:, group] == 0) if held_out else np.arange(len(x))
                        if len(at):
                            p = classes[(x[at] @ a.T + b).argmax(1)]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(q[at]), pa.array(y[at]), pa.array(p)], ["model", "q", "y", "p"])

    columns = [F.col("part").cast("int"), F.col("row_id").cast("long"), F.col("label").cast("int"), F.col("features").cast("array<double>"), *([F.col("w").cast("array<double>")] if held_out else [])]
    return rows.select(*columns).mapInArrow(run, "model int, q long, y int, p int")
