"""Probes of feature vectors: cosine nearest neighbours and multinomial logistic regression.

Nearest neighbours are exact and pruned. Both sides are packed into tiles of near vectors: rows are placed in the cell of the nearest
of a bounded number of centres, sorted by (cell, id) over ranges, and cut into tiles with a mean and a radius. Of unit vectors half the squared
chord is the cosine distance, and chords obey the triangle inequality. A first pass compares each tile of queries with the nearest training tiles that
hold k rows, which bounds every query's k-th distance; a second one compares only those pairs of tiles in which some query is
nearer to the tile's mean than its bound and the tile's radius allow. It deals both sides to blocks, each tile of queries to one block a part of the training
rows and the other way round: a task holds its block's queries and the training tiles pass by, so no tile is copied once a pair. No
query or training row comes to the driver but the centres, and every task's work is bounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import odd_values, sanitize
from ..storage import dropped, written
from . import linear
from .metrics import METRICS, metrics, summary
from .order import numbered_within
from .sampling import bootstrap_counts, size_curve

#: Rows of a tile of queries and of training rows; tiles of queries whose means are asked for their first tiles together, and tiles of training rows that pass by in a block.
QUERY_TILE, TRAIN_TILE = 512, 2048
QUERY_TILES, TRAIN_TILES = 8, 64
#: Means of tiles that are multiplied with a tile of queries at a time, and such packs in a block.
PACK, PACKS = 1024, 16
#: Rows for which there is one centre, and centres of all groups together (each group has one at least). Where no group has LEAST_CELLS
#: there is nothing to prune: all pairs of tiles are open and one pass compares them.
CELL_ROWS, CENTRES, LEAST_CELLS = 2048, 1024, 8
#: Full tiles of queries whose nearest rows a task holds, and blocks of all groups together into which smaller tables are cut too.
HELD, BLOCKS = 64, 16
#: Pairs of rows in a task whose pairs are all returned.
PAIRS = 1 << 25
DIGITS = 9
#: What rounding to DIGITS and floating point may add to a distance.
SLACK = 2.0 * 10**-DIGITS


FOUND = "grp long, key long, q long, train_id long, label int, dist double"


@dataclass(frozen=True)
class Searched:
    """Neighbours; where counted, the pairs of tiles of one group and how many of them were compared."""

    found: DataFrame
    pairs: int | None = None
    compared: int | None = None


def clean(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", sanitize(F.col("features")))


def replaced(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, replaced, vectors): how many values ``clean`` sets to 0, and in how many vectors; a null vector has none."""
    odd = F.coalesce(odd_values(F.col("features")), F.lit(0))
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(F.greatest(odd, F.lit(0))), F.lit(0)).alias("replaced"), F.count_if(odd > 0).alias("vectors"))


def unit(rows: DataFrame) -> DataFrame:
    """Vectors divided by their length; a zero vector stays zero, and so has distance 1 to everything."""
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("_norm", norm).withColumn("features", F.transform("features", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(0.0))).drop("_norm")


def _rows(df: DataFrame, key, group: str | None) -> DataFrame:
    """(grp, row_id, label, key, features): unit vectors of one side."""
    grp = F.col(group) if group else F.lit(0)
    return unit(clean(df)).select(grp.cast("long").alias("grp"), "row_id", F.coalesce("label", F.lit(0)).alias("label"), key.cast("long").alias("key"), "features")


def _centres(rows: DataFrame, seed: int = 42) -> dict[int, np.ndarray]:
    """Of each group some of its distinct vectors, those with the least hashes of their ids: one for about CELL_ROWS rows."""
    sizes = {r["grp"]: r["count"] for r in rows.groupBy("grp").count().collect()}  # one row a group
    wanted = {g: max(1, min(CENTRES // len(sizes), n // CELL_ROWS)) for g, n in sizes.items()}
    if max(wanted.values(), default=1) < LEAST_CELLS:
        return {}
    bounds = F.create_map(*[F.lit(x).cast("long") for g, n in sizes.items() for x in (g, int(2**62 * min(1.0, 4.0 * wanted[g] / n)))])
    hashed = rows.select("grp", "row_id", "features", F.shiftrightunsigned(F.xxhash64("row_id", F.lit(seed)), 2).alias("h"))
    drawn = hashed.filter(F.col("h") < bounds[F.col("grp")]).dropDuplicates(["grp", "row_id"]).toPandas()  # about four a centre
    out = {}
    for g, own in drawn.sort_values(["h", "row_id"]).groupby("grp"):
        vectors = np.stack(own["features"].to_numpy()).astype(float)
        out[g] = vectors[np.sort(np.unique(vectors, axis=0, return_index=True)[1])][: wanted[g]]
    return out


def _tiles(rows: DataFrame, per: int, centres: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(grp, key, ids, labels, vectors, mean, radius, n, least, tile): rows packed in tiles of at most ``per`` of one group and key, and,
    where centres are given, of one cell, in id order; the tiles' means and radii."""
    placed = rows.withColumn("cell", F.lit(0))
    if centres:
        sent = rows.sparkSession.sparkContext.broadcast(centres)

        @F.pandas_udf("int")
        def cell(grp: pd.Series, v: pd.Series) -> pd.Series:
            out = np.zeros(len(v), np.int32)
            for g in grp.unique():
                if (c := sent.value.get(g)) is not None:
                    own = np.flatnonzero(grp == g)
                    out[own] = ((c * c).sum(1) - 2 * np.stack(v.iloc[own].to_numpy()).astype(float) @ c.T).argmin(1)
            return pd.Series(out)

        # Ranges of (cell, id): a cell with very many rows is cut by ids, so its tiles' ids do not overlap.
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = ("grp", "key", "cell", "row_id")
        placed = rows.withColumn("cell", cell("grp", "features")).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        for batch in batches:
            for (grp, key, _), own in batch.sort_values("row_id", kind="stable").groupby(["grp", "key", "cell"]):
                for i in range(0, len(own), per):
                    some = own.iloc[i : i + per]
                    x = np.stack(some["features"].to_numpy()).astype(float)
                    mean = x.mean(0)
                    ids = some["row_id"].to_numpy(np.int64)
                    yield pd.DataFrame({"grp": [grp], "key": [key], "ids": [ids.tobytes()], "labels": [some["label"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()],
                                        "mean": [mean.tobytes()], "radius": [np.sqrt(((x - mean) ** 2).sum(1).max())], "n": [len(x)], "least": [ids[0]]})

    made = placed.mapInPandas(run, "grp long, key long, ids binary, labels binary, vectors binary, mean binary, radius double, n long, least long")
    return written(made.withColumn("tile", F.monotonically_increasing_id()), "tiles")


def _dealt(left: DataFrame, right: DataFrame, down: int, across: int, on: tuple[str, ...]) -> DataFrame:
    """Every row of left beside every row of right with the same ``on``, dealt by their ``at`` to down x across blocks."""
    part = lambda n: F.pmod(F.col("at"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("_down", part(down)).withColumn("_across", every(across)).drop("at")
    b = right.withColumn("_across", part(across)).withColumn("_down", every(down)).drop("at")
    return a.join(b, [*on, "_down", "_across"]).drop("_down", "_across")


def _rounded(cosines: np.ndarray) -> np.ndarray:
    """Rounded distances of cosines, in units of 10**-DIGITS."""
    return np.rint((1.0 - cosines) * 10**DIGITS).astype(np.int64)


def _near(vectors: np.ndarray, known: np.ndarray) -> np.ndarray:
    return _rounded(vectors @ known.T)


def _matrices(pair) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, training ids, labels and rounded distances of a pair of tiles."""
    own, ids, labels = (np.frombuffer(x, np.int64) for x in (pair.q_ids, pair.ids, pair.labels))
    vectors, known = (np.frombuffer(x).reshape(n, -1) for x, n in ((pair.q_vectors, len(own)), (pair.vectors, len(ids))))
    return own, ids, labels, _near(vectors, known)


def _best(k: int, ids: np.ndarray, labels: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dist, ids, labels) of the k nearest columns of each row, nearest first; the columns are in id order."""
    # Distance and place in one number: the k least are the nearest, and of equal ones those with the least ids.
    ranked = near * len(ids) + np.arange(len(ids))
    some = np.sort(np.partition(ranked, k - 1, axis=1)[:, :k] if k < len(ids) else ranked, axis=1)
    return some // len(ids), ids[some % len(ids)], labels[some % len(ids)]


def _merged(k: int, *found):
    both = [np.concatenate(x, axis=1) for x in zip(*found)]
    order = np.lexsort((both[1], both[0]))[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in both)


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0.0))


def _packs(tiles: DataFrame) -> DataFrame:
    """(grp, key, tiles, means, radii, sizes, leasts, at): what is known of tiles without their rows, PACK tiles a row."""

    def run(batches):
        for batch in batches:
            for (grp, key), own in batch.groupby(["grp", "key"]):
                for i in range(0, len(own), PACK):
                    some = own.iloc[i : i + PACK]
                    yield pd.DataFrame({"grp": [grp], "key": [key], "tiles": [some["tile"].to_numpy(np.int64).tobytes()], "means": [b"".join(some["mean"])],
                                        "radii": [some["radius"].to_numpy(float).tobytes()], "sizes": [some["n"].to_numpy(np.int64).tobytes()], "leasts": [some["least"].to_numpy(np.int64).tobytes()]})

    made = tiles.select("grp", "key", "tile", "mean", "radius", "n", "least").mapInPandas(run, "grp long, key long, tiles binary, means binary, radii binary, sizes binary, leasts binary")
    return made.withColumn("at", F.abs(F.xxhash64("tiles")))


def _first_tiles(queries: DataFrame, packs: DataFrame, k: int, down: int, across: int) -> DataFrame:
    """(q_tile, key, tile): for each tile of queries and key the nearest training tiles that hold k rows together."""

    def run(batches):
        for batch in batches:
            for pair in batch.itertuples(index=False):
                tiles, sizes, leasts = (np.frombuffer(x, np.int64) for x in (pair.tiles, pair.sizes, pair.leasts))
                mean = np.frombuffer(pair.mean)[None]
                far = np.round(_chords(mean, np.frombuffer(pair.means).reshape(len(tiles), -1))[0], 6)
                order = np.lexsort((leasts, far))
                order = order[: np.searchsorted(np.cumsum(sizes[order]), k) + 1]
                yield pd.DataFrame({"q_tile": pair.q_tile, "key": pair.key, "tile": tiles[order], "far": far[order], "least": leasts[order], "n": sizes[order]})

    means = queries.select("grp", "mean", F.col("tile").alias("q_tile"), F.col("tile").alias("at"))
    asked = _dealt(means, packs, down, across, ("grp",)).mapInPandas(run, "q_tile long, key long, tile long, far double, least long, n long")
    before = F.sum("n").over(Window.partitionBy("q_tile", "key").orderBy("far", "least", "tile").rowsBetween(Window.unboundedPreceding, -1))
    return written(asked.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < k).select("q_tile", "key", "tile"), "first-tiles")


def _first(queries: DataFrame, known: DataFrame, picks: DataFrame, k: int) -> DataFrame:
    """(grp, key, q_tile, q_ids, q_vectors, f_dist, f_ids, f_labels, f_tiles, width, cut, last): for each tile of queries and key the nearest rows of its first
    tiles, these tiles, and the distances and ids of the k-th rows if there are k; a group is a tile of queries and tiles of little more than k rows."""

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        best = None
        for pair in pairs.itertuples(index=False):
            _, ids, labels, near = _matrices(pair)
            found = _best(k, ids, labels, near)
            best = found if best is None else _merged(k, best, found)
        one, width = pairs.iloc[0], best[0].shape[1]
        cut, last = (x[:, -1].tobytes() if width >= k else None for x in best[:2])
        return pd.DataFrame({"grp": [one.grp], "key": [one.key], "q_tile": [one.q_tile], "q_ids": [one.q_ids], "q_vectors": [one.q_vectors],
                             "f_dist": [best[0].tobytes()], "f_ids": [best[1].tobytes()], "f_labels": [best[2].tobytes()], "f_tiles": [pairs["tile"].to_numpy(np.int64).tobytes()], "width": [width], "cut": [cut], "last": [last]})

    own = queries.select("grp", F.col("tile").alias("q_tile"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    rows = picks.join(known.select("tile", "ids", "labels", "vectors"), "tile").join(own, "q_tile")
    made = rows.groupBy("q_tile", "key").applyInPandas(run, "grp long, key long, q_tile long, q_ids binary, q_vectors binary, f_dist binary, f_ids binary, f_labels binary, f_tiles binary, width int, cut binary, last binary")
    return written(made, "first")


class _Nearest:
    """The nearest rows of a tile of queries (``row`` of ``_beside``) among the training tiles that it has met.

    ``cut`` and ``last`` are a distance and an id that a query's k-th row does not exceed, from the first pass or the rows found since;
    infinite where there are fewer than k. A tile whose ids are all larger than ``last`` has nothing for a query whose ``cut`` is 0, so copies of one
    vector, however many, are not compared with each other tile by tile.
    """

    def __init__(self, row, k: int):
        self.k, self.ids = k, np.frombuffer(row.ids, np.int64)
        n = len(self.ids)
        self.vectors = np.frombuffer(row.vectors).reshape(n, -1)
        self.cut, self.last, self.met = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max), np.zeros(0, np.int64)
        if row.f_tiles is not None:
            self.met = np.frombuffer(row.f_tiles, np.int64)
        if row.cut is not None:
            self.cut, self.last = np.frombuffer(row.cut, np.int64).astype(float), np.frombuffer(row.last, np.int64).copy()
        self.found = np.zeros((4, 0), np.int64)  # query's place, distance, id, label
        self.new, self.waiting = [], 0  # what was found since, and how many rows that is

    def meets(self, tile, ids, labels, known) -> bool:
        """Compare with a training tile; whether any query was."""
        if tile.tile in self.met:
            return False
        gap = np.maximum(_chords(self.vectors, np.frombuffer(tile.mean)[None])[:, 0] - tile.radius, 0.0)
        may = (gap * gap / 2 <= self.cut / 10**DIGITS + SLACK) & ~((self.cut <= 0) & (tile.least > self.last))
        at = np.flatnonzero(may)
        if not len(at):
            return False
        cosines, cut = self.vectors[at] @ known.T, self.cut[at]
        unbounded = np.isinf(cut).any()
        if unbounded:
            best = _best(self.k, ids, labels, _rounded(cosines))
            new = np.stack([np.repeat(at, best[0].shape[1]), *(x.ravel() for x in best)])
        else:
            # Only rows that may be near enough are rounded, which adds half a unit at most.
            q, column = np.nonzero(cosines >= 1.0 - (cut[:, None] + 1) / 10**DIGITS)
            near = _rounded(cosines[q, column])
            some = near <= cut[q]
            q, column = q[some], column[some]
            new = np.stack([at[q], near[some], ids[column], labels[column]])
        self.new.append(new)
        self.waiting += new.shape[1]
        if unbounded or 4 * self.waiting >= self.k * len(self.ids):
            self.sort()
        return True

    def sort(self) -> None:
        """Put what was found since the last time in order, keep k rows a query, and lower the bounds."""
        both = np.concatenate([self.found, *self.new], axis=1)
        self.new, self.waiting = [], 0
        both = both[:, np.lexsort((both[2], both[1], both[0]))]
        place = np.arange(both.shape[1]) - np.searchsorted(both[0], both[0])
        self.found, place = both[:, place < self.k], place[place < self.k]
        q, dist, last, _ = self.found[:, place == self.k - 1]
        less = (dist < self.cut[q]) | ((dist == self.cut[q]) & (last < self.last[q]))
        self.cut[q[less]], self.last[q[less]] = dist[less], last[less]

    def rows(self, grp: int, key: int) -> pd.DataFrame:
        self.sort()
        q, dist, ids, labels = self.found
        some = dist <= self.cut[q]
        return pd.DataFrame({"grp": grp, "key": key, "q": self.ids[q[some]], "train_id": ids[some], "label": labels[some], "dist": dist[some] / 10**DIGITS})


def _beside(asked: DataFrame, known: DataFrame, queries: DataFrame) -> DataFrame:
    """Tiles of queries and of training rows, each with a ``side``, dealt to blocks of a group that hold few enough tiles of queries: a task gets a
    block's queries and then its training tiles one after the other.

    A tile of queries goes to each part of the training rows, a training tile to each part of the queries, without the rows that the first pass found. Both
    numbers of parts are those of the largest group; smaller tables are cut too, on the side whose parts copy less. While all queries fit in one part, what is exchanged grows as the input does, and beyond that a tile's copies grow by one a part of the other side.
    """
    largest = lambda df: (df.groupBy("grp").agg(F.sum("n").alias("n")).agg(F.max("n"), F.count(F.lit(1))).first())
    (n_queries, groups), (n_known, _), tiles = largest(queries), largest(known), known.count()
    n_queries, n_known = n_queries or 0, n_known or 0
    parts = lambda n, per: max(1, -(-n // per))
    down = parts(n_queries, QUERY_TILE * HELD)
    across = min(parts(n_known, TRAIN_TILE * TRAIN_TILES), max(1, tiles))
    while down * across * max(1, groups) < BLOCKS and across < tiles:  # one more part of a side copies the other side once more
        if n_queries * across <= n_known * down:
            across = min(2 * across, tiles)
        else:
            down *= 2
    place = lambda n: F.pmod(F.xxhash64("tile"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    left = asked.select(F.lit(0).alias("side"), "grp", "key", "tile", "ids", *none("labels"), "vectors", *none("mean"), F.lit(0.0).alias("radius"), F.lit(0).cast("long").alias("least"),
                        "f_tiles", "cut", "last", place(down).alias("down"), every(across).alias("across"))
    right = known.select(F.lit(1).alias("side"), "grp", "key", "tile", "ids", "labels", "vectors", "mean", "radius", "least",
                         *none("f_tiles", "cut", "last"), every(down).alias("down"), place(across).alias("across"))
    block = ("grp", "down", "across")
    return left.unionByName(right).repartition(*block).sortWithinPartitions(*block, "side")


def _unbounded(queries: DataFrame) -> DataFrame:
    """Tiles of queries as ``_beside`` takes them, without a first pass."""
    none = lambda name: F.lit(None).cast("binary").alias(name)
    return queries.select("grp", "key", "tile", "ids", "vectors", none("f_tiles"), none("cut"), none("last"))


def _blocks(batches):
    """The tiles of a task as (whether a block begins, tile)."""
    before = None
    for batch in batches:
        for row in batch.itertuples(index=False):
            block = row.grp, row.down, row.across
            yield block != before, row
            before = block


def _compared(rows: DataFrame, k: int, by_key: bool, count=None) -> DataFrame:
    """(grp, key, q, train_id, label, dist): of the tiles of ``_beside`` the rows that may be among a query's k nearest. With by_key a tile of queries
    is compared with the training tiles of its own key only. ``count``: an accumulator of the pairs of tiles compared."""

    def kept(grp, held):
        for key, own in held.items():
            for one in own:
                yield one.rows(grp, key)

    def run(batches):
        grp, asked, held = None, [], {}
        for begins, row in _blocks(batches):
            if begins:
                yield from kept(grp, held)
                grp, asked, held = row.grp, [], {}
            if row.side == 0:
                asked.append(row)
                continue
            if row.key not in held:
                held[row.key] = [_Nearest(q, k) for q in asked if not by_key or q.key == row.key]
            ids, labels = (np.frombuffer(x, np.int64) for x in (row.ids, row.labels))
            known = np.frombuffer(row.vectors).reshape(len(ids), -1)
            met = sum(one.meets(row, ids, labels, known) for one in held[row.key])
            if count is not None:
                count.add(met)
        yield from kept(grp, held)

    return rows.mapInPandas(run, FOUND)


def _flat(first: DataFrame) -> DataFrame:
    """(grp, key, q, train_id, label, dist) of the first pass."""

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                q, dist, ids, labels = (np.frombuffer(x, np.int64) for x in (r.q_ids, r.f_dist, r.f_ids, r.f_labels))
                yield pd.DataFrame({"grp": r.grp, "key": r.key, "q": np.repeat(q, r.width), "train_id": ids, "label": labels, "dist": dist / 10**DIGITS})

    return first.drop("q_vectors", "cut", "last").mapInPandas(run, FOUND)


def searched(test: DataFrame, train: DataFrame, k: int, key: str | None = None, group: str | None = None, counted: bool = False) -> Searched:
    """``neighbours``, and if wanted how many pairs of tiles were compared."""
    asked, rows = _rows(test, F.lit(0), group), _rows(train, F.col(key) if key else F.lit(0), group)
    centres = _centres(rows)
    queries, known = _tiles(asked, QUERY_TILE, centres), _tiles(rows, TRAIN_TILE, centres)
    n_queries, n_known = queries.count(), known.count()
    parts = lambda n, per: max(1, -(-n // per))
    total = queries.select("grp").join(known.select("grp"), "grp").count() if counted else None
    if not centres:
        found = written(_ranked(_compared(_beside(_unbounded(queries), known, queries), k, False), k, key, group), "nearest")
        dropped(queries, known)
        return Searched(found, total, total)
    picks = _first_tiles(queries, _packs(known), k, parts(n_queries, QUERY_TILES * 64), parts(n_known, PACK * PACKS))
    first = _first(queries, known, picks, k)
    count = test.sparkSession.sparkContext.accumulator(0) if counted else None
    bounded = first.withColumnsRenamed({"q_tile": "tile", "q_ids": "ids", "q_vectors": "vectors"})
    found = _flat(first).unionByName(_compared(_beside(bounded, known, queries), k, True, count))
    found = written(_ranked(found, k, key, group), "nearest")  # k rows a query and key, not those of each block
    compared = picks.count() + count.value if counted else None
    dropped(queries, known, picks, first)
    return Searched(found, total, compared)


def _ranked(found: DataFrame, k: int, key: str | None, group: str | None) -> DataFrame:
    order = Window.partitionBy("grp", "key", "q").orderBy("dist", "train_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    for name, given in (("key", key), ("grp", group)):
        ranked = ranked.withColumnRenamed(name, given) if given else ranked.drop(name)
    return ranked


def neighbours(test: DataFrame, train: DataFrame, k: int, key: str | None = None, group: str | None = None) -> DataFrame:
    """(q, train_id, label, dist, rank): the k nearest training rows of every test row by cosine distance, rounded to
    nine digits; ties go to the smaller id. With ``key``, an integer column of the training rows, the k nearest of each key;
    with ``group``, an integer column of both sides, among the rows of the own group."""
    return searched(test, train, k, key, group).found


def distances(test: DataFrame, train: DataFrame) -> DataFrame:
    """(q, train_id, dist): the cosine distance of every test row to every training row. The result grows with the product of both sides, but what is
    exchanged and written before it with the sides: each tile is dealt to one part of its side, and a task reads one part of each. It holds a part of the
    queries while the training tiles pass by, and has about PAIRS rows of the result at most, so that tables of any size are spread over tasks."""

    def run(batches):
        for batch in batches:
            for pair in batch.to_pandas().itertuples(index=False):
                own, ids, _, near = _matrices(pair)
                for i in range(0, len(own), 64):
                    part = near[i : i + 64]
                    columns = np.repeat(own[i : i + 64], len(ids)), np.tile(ids, len(part)), part.ravel() / 10**DIGITS
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "train_id", "dist"])

    queries, known = (_tiles(_rows(df, F.lit(0), None), per) for df, per in ((test, QUERY_TILE), (train, TRAIN_TILE)))
    (n_queries, q_tiles), (n_known, tiles) = (df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first() for df in (queries, known))
    parts = lambda n, per, tiles: max(1, min(-(-n // per), tiles))
    most = max(1, min(PAIRS, n_queries * n_known // BLOCKS))
    down = parts(n_queries, min(max(math.isqrt(most), most // max(1, n_known)), QUERY_TILE * HELD), q_tiles)
    across = parts(n_queries * n_known, most * down, tiles)
    asked = queries.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")).repartition(down)
    dealt = known.select("ids", "labels", "vectors").repartition(across)
    return dealt.hint("shuffle_replicate_nl").crossJoin(asked).mapInArrow(run, "q long, train_id long, dist double")


def vote(found: DataFrame, *keys: str, weight=None) -> DataFrame:
    """(keys, q, p): the label with most neighbours; ties go to the smallest label."""
    counts = found.groupBy(*keys, "q", "label").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    return counts.groupBy(*keys, "q").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("p"))


def truth(test: DataFrame, *keys: str) -> DataFrame:
    return test.select(*keys, F.col("row_id").alias("q"), F.col("label").alias("y"))


def evaluate_knn(test: DataFrame, train: DataFrame, ks: list[int], key: str | None = None, group: str | None = None) -> DataFrame:
    """The five metrics for every k (key of the training rows, and group); neighbours are ranked once."""
    groups = [group] if group else []
    keys = [*groups, *([key] if key else [])]
    grid = F.explode(F.array(*map(F.lit, sorted(ks)))).alias("k")
    voting = neighbours(test, train, max(ks), key, group).select("*", grid).filter(F.col("rank") <= F.col("k"))
    return metrics(vote(voting, "k", *keys).join(truth(test, *groups), [*groups, "q"]), "k", *keys)


def _reach(k: int, lists: int) -> int:
    """How many of a query's nearest rows hold k draws in all of so many lists, but for a chance of a hundredth: draws of a row are Poisson with mean 1 at most."""
    few = lambda n: sum(math.exp(i * math.log(n) - n - math.lgamma(i + 1)) for i in range(k))
    size = max(k, 1)
    while lists * few(size) > 0.01:
        size += 1
    return size


def _redrawn(near: DataFrame, k: int, reps: int, draws: int) -> DataFrame:
    """(q, p): for every repetition the label that most of a query's k nearest draws have, of equals the smallest, and null where
    there are none; no list where a repetition finds fewer than ``draws`` among the rows of near (q, label, rank, mult array<int> or null: never drawn). Rows are exchanged once a neighbour, with the draws of all repetitions."""

    def votes(rows: pa.Table) -> pa.RecordBatch:
        q, label = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        mult = rows.column(2).combine_chunks().flatten().to_numpy().reshape(len(q), reps).astype(np.int64)
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        own = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(q)]))
        before = np.cumsum(mult, axis=0) - mult
        take = np.clip(k - (before - before[first][own]), 0, mult)
        short = (np.add.reduceat(take, first, axis=0) < draws).any(1)
        # The votes of a label and its place among the query's labels in one number: the largest has most votes, and of equals the smallest label.
        order = np.lexsort((label, own))
        label, own = label[order], own[order]
        pair = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (label[1:] != label[:-1])])
        of = own[pair]
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        place = np.arange(len(pair)) - start[of]
        width = int(place.max()) + 1
        best = np.maximum.reduceat(np.add.reduceat(take[order], pair, axis=0) * width + (width - 1 - place)[:, None], start, axis=0)
        p = pa.array(label[pair][start[:, None] + width - 1 - best % width].astype(np.int32).ravel(), mask=(best < width).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * reps), p, mask=pa.array(short))
        return pa.RecordBatch.from_arrays([pa.array(q[first]), lists], ["q", "p"])

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            q = rows.column(0).to_numpy()
            last = len(q) - int((q[::-1] == q[-1]).argmin() or len(q))  # where the last query begins, whose rows may go on
            if last:
                yield votes(rows.slice(0, last))
            rest = rows.slice(last)
        if rest is not None:
            yield votes(rest)

    placed = near.repartition("q").sortWithinPartitions("q", "rank")
    return placed.select("q", "label", F.coalesce(F.col("mult").cast("array<int>"), F.array_repeat(F.lit(0), reps)).alias("mult")).mapInArrow(run, "q long, p array<int>")


def bootstrap_knn(test: DataFrame, train: DataFrame, k: int, reps: int, seed: int = 42, margin: int = 16) -> DataFrame:
    """(rep, the five metrics) over stratified bootstraps of the training rows.

    Distances are found once; a repetition takes a neighbour as often as it was drawn until k draws are reached. Neighbours are never
    multiplied by repetitions: each carries its draws in all of them as an array, and a task that has a query's neighbours votes in all of them. Queries whose
    list does not hold k draws of every repetition are asked again, and only these, for twice as many.
    """
    least = F.transform("mult", lambda m: F.least(m, F.lit(k)).cast("byte" if k < 128 else "int"))  # no more than k are ever taken
    drawn = written(bootstrap_counts(train, reps, seed).select(F.col("row_id").alias("train_id"), least.alias("mult")), "drawn")
    known, asked, found, again = train.count(), test, None, None
    size = max(k + margin, _reach(k, test.count() * reps))
    while True:
        near = neighbours(asked, train, min(size, known)).select("q", "train_id", "label", "rank").join(drawn, "train_id", "left")
        votes = written(_redrawn(near, k, reps, k if size < known else 0), "votes")
        full = votes.filter(F.col("p").isNotNull())
        found = full if found is None else found.unionByName(full)
        short = votes.filter(F.col("p").isNull()).select(F.col("q").alias("row_id"))
        if size >= known or short.isEmpty():
            break
        again, size = written(asked.join(short, "row_id", "left_semi"), "asked-again", again), 2 * size
        asked = again
    dropped(drawn)
    return metrics(found.join(truth(test), "q").select("y", F.posexplode("p").alias("rep", "p")).filter("p is not null"), "rep")


def standardiser(train: DataFrame, weight: str | None = None) -> DataFrame:
    """(pos, mean, scale) of the training rows: population deviation, 1 where it is 0; weights count as repeats."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    long = train.select(w.alias("w"), F.posexplode("features").alias("pos", "v"))
    mean = long.groupBy("pos").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"))
    if weight is None:
        std = long.groupBy("pos").agg(F.stddev_pop("v").alias("std"))
    else:
        std = long.join(F.broadcast(mean), "pos").groupBy("pos").agg(F.sqrt(F.sum(F.col("w") * F.pow(F.col("v") - F.col("mean"), F.lit(2))) / F.sum("w")).alias("std"))
    return mean.join(std, "pos").select("pos", "mean", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0).alias("scale"))


def standardise(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Apply a standardiser; its two vectors (one value a dimension) are sent to the rows."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda s: s[c])
    vectors = fitted.agg(ordered("mean").alias("_m"), ordered("scale").alias("_s"))
    scaled = F.transform("features", lambda x, i: (x - F.get("_m", i)) / F.get("_s", i))
    return rows.crossJoin(F.broadcast(vectors)).withColumn("features", scaled).drop("_m", "_s")


def fit_linear(train: DataFrame, c: float, weight: str | None = None, max_iter: int = 1000):
    """Multinomial logistic regression with penalty |w|^2 / 2 and C times the summed loss, as a Spark ML model of standardised rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    total = train.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
    model = LogisticRegression(
        family="multinomial", regParam=1.0 / (c * float(total)), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-6, labelCol="label", featuresCol="vector",
    )
    if weight:
        model = model.setWeightCol(weight)
    return model.fit(train.withColumn("vector", array_to_vector("features")))


def predict_linear(model, test: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    scored = model.transform(test.withColumn("vector", array_to_vector("features")))
    return scored.select(F.col("row_id").alias("q"), F.col("label").alias("y"), F.col("prediction").cast("int").alias("p"))


C_GRID = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)


def folds(train: DataFrame, n: int = 3, label: str = "label") -> DataFrame:
    """train with ``fold``: contiguous parts of each class in id order, the first ones larger by one where sizes differ."""
    placed = numbered_within(train, label, "row_id", name="_at", size="_n")
    least = F.expr(f"_n div {n}")
    large = F.col("_n") % n  # so many parts have one row more
    later = F.when(least > 0, F.expr(f"(_at - (_n % {n}) * (_n div {n} + 1)) div greatest(_n div {n}, 1)")).otherwise(0)
    fold = F.when(F.col("_at") < large * (least + 1), F.expr(f"_at div (_n div {n} + 1)")).otherwise(large + later)
    return placed.withColumn("fold", fold.cast("int")).drop("_at", "_n")


def choose_c(train: DataFrame, grid=C_GRID, n: int = 3) -> tuple[float, list[tuple[float, float]]]:
    """The C with the best mean accuracy over folds (the first of equals), and every C's mean."""
    chosen, found = choose_many(train.withColumn("part", F.lit(0)), grid, n)
    return chosen[0], found[0]


def choose_many(train: DataFrame, grid=C_GRID, n: int = 3) -> tuple[dict[int, float], dict[int, list[tuple[float, float]]]]:
    """The same for every ``part`` of the rows: all C, folds and parts are fitted together."""
    parts = [r[0] for r in train.select("part").distinct().collect()]  # one row a part
    placed = written(_fold_weights(train, n), "folds")
    blocks = linear.packed(placed)
    models = [linear.Model(p, f, n, float(c)) for p in parts for c in grid for f in range(n)]
    predicted = linear.predict_many(placed, linear.fit_many(blocks, models), held_out=True)
    right = {r["model"]: r["accuracy"] for r in predicted.groupBy("model").agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy")).collect()}  # one row a model
    dropped(placed, blocks)
    found = {p: [(float(c), float(np.mean([right[i] for i, m in enumerate(models) if (m.part, m.c) == (p, float(c)) and i in right] or [0.0]))) for c in grid] for p in parts}
    return {p: max(own, key=lambda x: x[1])[0] for p, own in found.items()}, found


def _fold_weights(train: DataFrame, n: int) -> DataFrame:
    """train with ``w``: for each fold 0 where the row is held out and 1 elsewhere, and 1 for all of them."""
    keyed = train.withColumn("_class", F.struct("part", "label"))
    return folds(keyed, n, "_class").withColumn("w", F.array(*[(F.col("fold") != f).cast("double") for f in range(n)], F.lit(1.0))).drop("_class", "fold")


def evaluate_linear(test: DataFrame, train: DataFrame, c: float | list[float] | None = None) -> DataFrame:
    """The five metrics and ``c``. A list (or None: the default grid) is searched by cross-validation first."""
    one = F.lit(0).alias("part")
    return evaluate_linear_many(test.select("*", one), train.select("*", one), c).drop("part")


def evaluate_linear_many(test: DataFrame, train: DataFrame, c: float | list[float] | None = None) -> DataFrame:
    """(part, the five metrics, c) for every ``part`` of the training and test rows; all parts are fitted together."""
    columns = ("part", "row_id", "label", "features")
    known = written(clean(train).select(*columns), "linear-rows")
    parts = [r[0] for r in known.select("part").distinct().collect()]  # one row a part
    best = {p: float(c) for p in parts} if isinstance(c, (int, float)) else choose_many(known, tuple(c) if c else C_GRID)[0]
    blocks = linear.packed(known.withColumn("w", F.array(F.lit(1.0))))
    fitted = linear.fit_many(blocks, [linear.Model(p, 0, 0, best[p]) for p in parts])
    dropped(blocks, known)
    chosen = test.sparkSession.createDataFrame([(i, p, best[p]) for i, p in enumerate(parts)], "model int, part int, c double")
    return metrics(linear.predict_many(clean(test).select(*columns), fitted), "model").join(F.broadcast(chosen), "model").drop("model")


def bootstrap_linear(test: DataFrame, train: DataFrame, reps: int, c: float = 1.0, seed: int = 42) -> DataFrame:
    """(rep, the five metrics): for each repetition the scaler and the model are fitted with the drawn multiplicities as weights, all together."""
    one = F.lit(0).alias("part")
    return bootstrap_linear_many(test.select("*", one), train.select("*", one), reps, c, seed).drop("part")


def bootstrap_linear_many(test: DataFrame, train: DataFrame, reps: int, c: float = 1.0, seed: int = 42) -> DataFrame:
    """(part, rep, the five metrics) for every ``part``; a part's rows are drawn within its classes."""
    columns = ("part", "row_id", "label", "features")
    known = written(clean(train).select(*columns), "linear-rows")
    parts = [r[0] for r in known.select("part").distinct().collect()]  # one row a part
    drawn = None
    for p in parts:
        own = bootstrap_counts(known.filter(F.col("part") == p), reps, seed).select(F.lit(p).alias("part"), "row_id", F.col("mult").cast("array<double>").alias("w"))
        drawn = own if drawn is None else drawn.unionByName(own)
    blocks = linear.packed(known.join(drawn, ["part", "row_id"]))
    named = [(p, r) for p in parts for r in range(reps)]
    fitted = linear.fit_many(blocks, [linear.Model(p, r, r, c) for p, r in named])
    dropped(blocks, known)
    models = test.sparkSession.createDataFrame([(i, p, r) for i, (p, r) in enumerate(named)], "model int, part int, rep int")
    return metrics(linear.predict_many(clean(test).select(*columns), fitted), "model").join(F.broadcast(models), "model").drop("model")


def _splits(features: DataFrame) -> list[str]:
    return [r[0] for r in features.select("split_type").distinct().orderBy("split_type").collect()]  # a few names


def sweep(features: DataFrame, methods: dict[str, DataFrame], ks: list[int], sizes: list[int], seed: int = 42) -> DataFrame:
    """kNN metrics for methods x split types x training sizes x k. features: the labelled splits (row_id, label,
    split_type, role); methods: name -> (row_id, features). A method's vectors are made once, samples are drawn once for all
    methods, and all methods, splits, sizes and k come from one ranking."""
    names, splits = sorted(methods), _splits(features)
    vectors = None
    for m, name in enumerate(names):
        one = methods[name].select("row_id", "features", F.lit(m).alias("method"))
        vectors = one if vectors is None else vectors.unionByName(one)
    vectors = written(vectors, "sweep")
    labelled, train = features.select("row_id", "label", "split_type", "role"), None
    for split in splits:
        one = size_curve(labelled.filter((F.col("split_type") == split) & (F.col("role") == "train")), sizes, seed)
        train = one if train is None else train.unionByName(one)
    train = written(train, "sweep-train")
    number = F.array_position(F.array(*map(F.lit, splits)), F.col("split_type")).cast("int") - 1
    grouped = lambda rows: rows.join(vectors, "row_id").withColumn("grp_id", F.col("method") * len(splits) + number)
    used = train.groupBy("split_type", "n_train").agg(F.count(F.lit(1)).alias("train_samples"))
    found = evaluate_knn(grouped(labelled.filter("role = 'test'")), grouped(train), ks, "n_train", "grp_id")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    named = found.withColumn("pool", pick(names, F.expr(f"grp_id div {len(splits)}"))).withColumn("split_type", pick(splits, F.col("grp_id") % len(splits))).withColumn("n_train", F.col("n_train").cast("int"))
    return named.join(F.broadcast(used), ["split_type", "n_train"]).select("pool", "split_type", "n_train", "k", "train_samples", *METRICS)


def bootstrap_sweep(features: DataFrame, methods: dict[str, DataFrame], k: int, reps: int, seed: int = 42) -> DataFrame:
    """(pool, split_type, metric, mean, std, ci_lower, ci_upper) of kNN over bootstraps of each split's training rows."""
    out = None
    for name, vectors in sorted(methods.items()):
        rows = written(features.select("row_id", "label", "split_type", "role").join(vectors.select("row_id", "features"), "row_id"), "sweep")
        for split in _splits(features):
            own = rows.filter(F.col("split_type") == split)
            one = summary(bootstrap_knn(own.filter("role = 'test'"), own.filter("role = 'train'"), k, reps, seed)).select(F.lit(name).alias("pool"), F.lit(split).alias("split_type"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def _linear_parts(features: DataFrame, methods: dict[str, DataFrame], sizes: list[int], seed: int) -> tuple[list[tuple[str, str, int]], DataFrame, DataFrame]:
    """Methods x split types x training sizes as parts: their names, test rows and training rows. Samples are drawn once for all methods."""
    names, splits = sorted(methods), _splits(features)
    parts = [(m, s, n) for m in names for s in splits for n in sizes]
    labelled, test, train = features.select("row_id", "label", "split_type", "role"), None, None
    for s in splits:
        own = labelled.filter(F.col("split_type") == s)
        sampled = written(size_curve(own.filter("role = 'train'").select("row_id", "label"), sizes, seed), "sweep-train")
        for p, (m, split, n) in enumerate(parts):
            if split == s:
                vectors = methods[m].select("row_id", F.col("features").cast("array<double>").alias("features"))
                asked = own.filter("role = 'test'").select("row_id", "label").join(vectors, "row_id").withColumn("part", F.lit(p))
                known = sampled.filter(F.col("n_train") == n).select("row_id", "label").join(vectors, "row_id").withColumn("part", F.lit(p))
                test, train = (known if x is None else x.unionByName(known) for x, known in ((test, asked), (train, known)))
    return parts, written(test, "sweep-test"), written(train, "sweep-train")


def linear_sweep(features: DataFrame, methods: dict[str, DataFrame], sizes: list[int], c: float | list[float] | None = None, seed: int = 42) -> DataFrame:
    """Linear metrics for methods x split types x training sizes; ``c`` as in ``evaluate_linear``. All models, those of the search for C
    included, are fitted together."""
    methods = {m: written(v.select("row_id", "features"), "sweep") for m, v in methods.items()}
    parts, test, train = _linear_parts(features, methods, sizes, seed)
    names = features.sparkSession.createDataFrame([(p, *x) for p, x in enumerate(parts)], "part int, pool string, split_type string, n_train int")
    used = train.groupBy("part").agg(F.count(F.lit(1)).alias("train_samples"))
    found = evaluate_linear_many(test, train, c).join(F.broadcast(names), "part").join(F.broadcast(used), "part")
    return found.select("pool", "split_type", "n_train", "train_samples", "c", *METRICS)


def linear_bootstrap_sweep(features: DataFrame, methods: dict[str, DataFrame], reps: int, c: float = 1.0, seed: int = 42) -> DataFrame:
    """(pool, split_type, metric, mean, std, ci_lower, ci_upper) of linear probes over bootstraps of each split's training rows; fitted together."""
    methods = {m: written(v.select("row_id", "features"), "sweep") for m, v in methods.items()}
    parts, test, train = _linear_parts(features, methods, [-1], seed)
    found = written(bootstrap_linear_many(test, train, reps, c, seed), "sweep-reps")
    out = None
    for p, (pool, split, _) in enumerate(parts):
        one = summary(found.filter(F.col("part") == p)).select(F.lit(pool).alias("pool"), F.lit(split).alias("split_type"), "*")
        out = one if out is None else out.unionByName(one)
    return out
