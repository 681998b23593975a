"""Exact Jaccard join of word shingle sets as a metric-space join.

The Jaccard distance is a metric. A pivot's Voronoi region holds the documents that are nearer to it than to other pivots, and besides
them those whose distance to it is at most twice the threshold more than the least one: by the triangle inequality, of two linked
documents both lie in the region of the pivot that is nearest to either. Regions are split again by pivots of their own until they are small,
and a small region is compared exactly in one task. Documents within the threshold of a pivot are linked to it at once, so that
what hangs together already needs no more comparisons.

Most documents have a distance of 1, or nearly so, to every pivot, and so would lie in all regions. Two steps that lose no link come first:

* A shingle that no other set has is in no intersection. A set with more of them than a link leaves room for has no link. They are counted over
  all documents, among the shingles whose hash lies in a fixed part of all hashes (``PART``; small sets: among all shingles).
* Of the sets that are left, each comes with its rarest shingles, as many as a link can do without and one more; two linked sets share
  one of these. All that share one are a root cell, and the cell's first document in a seeded order is its pivot: its region is all cells that
  it leads.

A region that pivots don't take apart (a child of more than half of its rows) is cut into chunks of its local components and every two chunks
are a small region, except those of the same component: the exact way for dense families, in blocks of bounded size.

Shingles are compared by 64-bit hashes. Defined cases: a null text has no words; no words are an empty set, which is linked with nothing; fewer
words than a shingle has are one shingle; equal sets are one node; repeated rows and ids are each classified; rows with a null id take part, and a
class of nothing but null ids has none; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, materialise, table
from .components import components
from .simhash import _hashes, words_of

SHINGLE = 3
#: Sets link from LIKE[0] / LIKE[1] on.
LIKE = (9, 10)
#: 2 ** 64 / PART hashes are looked at when lonely shingles are counted; sets of less than FULL shingles are looked at whole.
PART, FULL = 4, 72
#: Documents and shingles of a region that one task compares; pivots of a larger one; documents beside its pivots in a task.
LEAF, LEAF_SHINGLES, PIVOTS, DEALT = 256, 8_000_000, 16, 2048
#: Columns of a leaf's matrix at a time.
COLUMNS = 16_384


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's different shingles, in ascending order."""
    words = words_of(text)
    return np.unique(_hashes(words, shingle)) if words else np.zeros(0, np.uint64)


def least_shared(n: Column, like: tuple[int, int]) -> Column:
    """Shingles that a set of n shares at least with a set it is linked to."""
    return F.ceil(n * like[0] / like[1]).cast("long")


def read(docs: DataFrame, shingle: int, part: int = PART, key: str | None = None) -> DataFrame:
    """(row, doc_id, n, same, text_key, some): a number for each row (or its key), the set's size and digest, a digest of the text, and the hashes that are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        most = np.uint64((1 << 64) // part - 1)
        for batch in batches:
            n, same, some = [], [], []
            for text in batch.column(2):
                own = shingle_set(text.as_py(), shingle)
                n.append(len(own))
                same.append(xxhash.xxh3_128_digest(own.tobytes()))
                some.append((own if len(own) < FULL else own[: np.searchsorted(own, most, "right")]).view(np.int64))
            offsets = np.r_[0, np.cumsum([len(x) for x in some])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(some) if some else np.zeros(0, np.int64)))
            made = [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(same, pa.binary()), lists, *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "text_key", "n", "same", "some", *["row"] * (len(made) - 5)])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"), text.alias("text"), *([F.col(key).alias("row")] if key else []))
    made = rows.mapInArrow(run, "doc_id long, text_key binary, n long, same binary, some array<long>" + ", row long" * bool(key))
    return materialise(made if key else made.withColumn("row", F.monotonically_increasing_id()), "jaccard-rows")


def not_lonely(rows: DataFrame, like: tuple[int, int], part: int = PART) -> DataFrame:
    """(node, text_key, doc_id): one row a different set that has too few lonely shingles to be without links for certain."""
    nodes = rows.filter("n > 0").groupBy("same").agg(F.min(F.struct("row", "n", "text_key", "doc_id", "some")).alias("f")).select(F.col("f.row").alias("node"), "f.n", "f.text_key", "f.doc_id", "f.some")
    nodes = materialise(nodes, "jaccard-nodes")
    # A shingle counts as lonely only where every set that could be linked with its set shows it too.
    counted = (F.col("n") * like[1] < FULL * like[0]) | F.col("s").between(0, (1 << 64) // part - 1)
    seen = nodes.select("node", "n", F.explode("some").alias("s")).select("s", F.when(counted, F.col("node")).alias("node"))
    once = seen.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter("c = 1 and node is not null")
    lonely = once.groupBy("node").agg(F.count(F.lit(1)).alias("lonely"))
    kept = nodes.select("node", "n", "text_key", "doc_id").join(lonely, "node", "left").filter(F.coalesce("lonely", F.lit(0)) <= F.col("n") - least_shared(F.col("n"), like))
    out = materialise(kept.select("node", "text_key", "doc_id"), "jaccard-live")
    dropped(nodes)
    return out


def sets_of(docs: DataFrame, live: DataFrame, shingle: int) -> DataFrame:
    """(node, n, s): the sets of the nodes, as bytes of ascending hashes; one row a node.

    Texts are found by their digest and the id of one of their rows, so that many copies of a text don't meet. The texts of all
    documents are exchanged once for it, whatever the size: how many nodes are left has no bound that would allow to send them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 8 for x in own], pa.int64()), pa.array(own, pa.binary())], ["node", "n", "s"])

    text = F.col("text").cast("string")
    texts = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("text_key"), F.col("doc_id").cast("long").alias("id"), text.alias("text")).filter("text is not null")
    texts = texts.join(live.hint("merge"), (texts.text_key == live.text_key) & texts.id.eqNullSafe(live.doc_id))
    return materialise(texts.select("node", "text").dropDuplicates(["node"]).mapInArrow(run, "node long, n long, s binary"), "jaccard-sets")


def _hashes_of(sets: DataFrame) -> DataFrame:
    """(node, s): a row for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            for i in range(0, batch.num_rows, LEAF):
                here = slice(i, i + LEAF)
                own = np.frombuffer(b"".join(batch.column(2).slice(i, LEAF).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy()[here], n[here])), pa.array(own)], ["node", "s"])

    return sets.mapInArrow(run, "node long, s long")


def root_regions(sets: DataFrame, like: tuple[int, int]) -> DataFrame:
    """(region, node): each set in the regions of the pivots of its rarest shingles' cells."""
    shared = materialise(_hashes_of(sets).groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "jaccard-df")
    own = _hashes_of(sets).join(shared, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("own")).join(sets.select("node", "n"), "node")
    # Shingles of no other set are the rarest, and make no cell.
    room = (F.size("own") - least_shared(F.col("n"), like) + 1).cast("int")
    rare = materialise(own.filter(room > 0).select("node", F.explode(F.slice("own", F.lit(1), room)).alias("o")).select("node", "o.s"), "jaccard-rare")
    cells = materialise(rare.groupBy("s").agg(F.min(F.xxhash64("node")).alias("region"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("s", "region"), "jaccard-cells")
    out = materialise(rare.join(cells, "s").select("region", "node").distinct(), "jaccard-regions")
    dropped(shared, rare, cells)
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with equal first columns, and these; a run's rows are held together."""
    key, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of different sets; the diagonal is not used."""
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], float)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(at, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    kept = often[at]
    owner, at = owner[kept], number[at[kept]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(sets), len(sets)))
    for first in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(at, [first, first + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, int(often.sum()) - first)), np.float32)
        x[owner[a:b], at[a:b] - first] = 1
        out += x @ x.T
    return out


def compared(leaves: DataFrame, sets: DataFrame, like: tuple[int, int]) -> DataFrame:
    """(u, v): links that hold together what hangs together in each small region. leaves: (region, node, comp); rows of the
    same comp (but -1) are known to hang together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for _, rows in _runs(batches, 1):
            if len(rows) < 2:
                continue
            groups = _Union(len(rows))
            known: dict[int, int] = {}
            for i, (_, comp, _) in enumerate(rows):
                if comp >= 0:
                    groups.join(known.setdefault(comp, i), i)
            own = [np.frombuffer(r[2], np.uint64) for r in rows]
            n, both = np.array([len(x) for x in own]), common(own)
            linked = both * like[1] >= like[0] * (n[:, None] + n - both)
            for i, j in np.argwhere(np.triu(linked, 1)):
                if groups.join(int(i), int(j)):
                    us.append(rows[i][0])
                    vs.append(rows[j][0])
            if len(us) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = leaves.join(sets.select("node", "s"), "node").select("region", "node", "comp", "s")
    return materialise(rows.repartition(parts, "region").sortWithinPartitions("region", "node").mapInArrow(run, "u long, v long"), "jaccard-links")


def measured(members: DataFrame, sets: DataFrame, like: tuple[int, int], level: int) -> DataFrame:
    """(region, size, node, comp, links, homes) of large regions: a component the document is known to belong to (-1: none), the pivots it is linked
    to, and the Voronoi regions it belongs to, windows included. members: (region, size, node, comp)."""
    reach = 2 * (like[1] - like[0]) / like[1] + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (region, _), rows in _runs(batches, 2):
            pivots = [(node, comp, np.frombuffer(s, np.uint64)) for kind, _, node, comp, s in rows if kind == 0]
            sizes = np.array([len(s) for _, _, s in pivots])
            both = common([s for _, _, s in pivots]) if len(pivots) > 1 else np.diag(sizes)
            groups = _Union(len(pivots))
            for i, j in np.argwhere(np.triu(both * like[1] >= like[0] * (sizes[:, None] + sizes - both), 1)):
                groups.join(int(i), int(j))
            # A group of pivots is named after a component that one of them belongs to, or else after a pivot.
            names: dict[int, int] = {}
            for i, (node, comp, _) in enumerate(pivots):
                if comp >= 0 or groups.root(i) not in names:
                    names[groups.root(i)] = comp if comp >= 0 else node
            values = np.concatenate([s for _, _, s in pivots])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], np.repeat(np.arange(len(pivots)), sizes)[order]
            out = []
            for kind, size, node, comp, s in rows:
                if kind == 0:
                    continue
                own = np.frombuffer(s, np.uint64)
                at = np.searchsorted(own, values)
                both = np.bincount(owner[own[np.minimum(at, len(own) - 1)] == values], minlength=len(pivots))
                union = len(own) + sizes - both
                linked, far = np.flatnonzero(both * like[1] >= like[0] * union), 1 - both / union
                known = comp if comp >= 0 or not len(linked) else names[groups.root(int(linked[0]))]
                out.append((region, size, node, known, [pivots[j][0] for j in linked if pivots[j][0] != node], np.flatnonzero(far <= far.min() + reach).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())))], ["region", "size", "node", "comp", "links", "homes"])

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = members.withColumn("place", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(level)), "node"))).filter(F.col("place") <= PIVOTS)
    deals = (F.expr(f"size div {DEALT}") + 1).cast("int")
    pivots = ranked.select("region", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"), F.lit(0).alias("kind"), "size", "node", "comp")
    dealt = members.select("region", F.pmod(F.xxhash64("node"), deals).cast("int").alias("deal"), F.lit(1).alias("kind"), "size", "node", "comp").unionByName(pivots)
    rows = dealt.join(sets.select("node", "s"), "node").select("region", "deal", "kind", "size", "node", "comp", "s").repartition(parts, "region", "deal").sortWithinPartitions("region", "deal", "kind", "node")
    return materialise(rows.mapInArrow(run, "region long, size long, node long, comp long, links array<long>, homes array<int>"), "jaccard-measured")


def _sized(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members with their region's rows (size) and shingles (held), without regions that are known to hang together."""
    sizes = members.join(sets.select("node", "n"), "node").groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("held"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return members.hint("merge").join(sizes.filter("lo < 0 or lo < hi").select("region", "size", "held"), "region")


def _small() -> str:
    return f"size <= 2 or size <= {LEAF} and held <= {LEAF_SHINGLES}"


def set_links(sets: DataFrame, like: tuple[int, int], known: DataFrame | None = None) -> DataFrame:
    """(u, v): links between nodes whose components are those of all links. known: (node, comp), components that links found before make;
    those links are not found again."""
    found, leaves, level = [], [], 0
    members = root_regions(sets, like)
    members = members.withColumn("comp", F.lit(-1).cast("long")) if known is None else members.join(known, "node", "left").withColumn("comp", F.coalesce("comp", F.lit(-1)))
    members = materialise(_sized(members.select("region", "node", "comp"), sets), "jaccard-members")
    while True:
        leaves.append(members.filter(_small()).select("region", "node", "comp"))
        large = members.filter(f"not ({_small()})")
        if large.isEmpty():
            break
        seen = measured(large.select("region", "size", "node", "comp"), sets, like, level)
        found.append(seen.select(F.col("node").alias("u"), F.explode("links").alias("v")))
        # Children that are one local component are done.
        homes = seen.select("region", "size", "node", "comp", F.explode("homes").alias("home"))
        children = homes.groupBy("region", "size", "home").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).withColumn("done", F.col("lo").eqNullSafe(F.col("hi")) & (F.col("lo") >= 0))
        stuck = children.filter(~F.col("done")).groupBy("region", "size").agg(F.max("c").alias("c")).filter(F.col("c") * 2 > F.col("size")).select("region")
        stuck = materialise(stuck, "jaccard-stuck")
        split = children.filter(~F.col("done")).join(stuck, "region", "left_anti").select("region", "home")
        below = homes.hint("merge").join(split, ["region", "home"]).select(F.xxhash64("region", "home", F.lit(level)).alias("region"), "node", "comp")
        leaves.append(_in_chunks(seen.join(stuck, "region", "left_semi").select("region", "node", "comp"), level))
        members = materialise(_sized(below, sets), "jaccard-members")
        level += 1
    found.append(compared(reduce(DataFrame.unionByName, leaves), sets, like))
    return reduce(DataFrame.unionByName, found)


def _in_chunks(members: DataFrame, level: int) -> DataFrame:
    """Small regions of every two chunks of a region, of different local components or of none."""
    groups = members.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("c")).withColumn("chunks", F.expr(f"cast(c div {LEAF // 2} + 1 as int)"))
    placed = members.hint("merge").join(groups, ["region", "comp"]).select("region", "node", "comp", F.pmod(F.xxhash64("node", F.lit(level)), F.col("chunks")).cast("int").alias("chunk"))
    chunks = groups.select("region", "comp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    a, b = chunks.alias("a"), chunks.alias("b")
    at = lambda t: F.struct(F.col(f"{t}.comp"), F.col(f"{t}.chunk"))
    pairs = a.join(b, (F.col("a.region") == F.col("b.region")) & (at("a") <= at("b")) & ((F.col("a.comp") != F.col("b.comp")) | (F.col("a.comp") == -1)))
    pairs = pairs.select(F.col("a.region").alias("region"), F.xxhash64(F.lit("chunks"), F.lit(level), "a.region", at("a"), at("b")).alias("pair"), F.explode(F.array_distinct(F.array(at("a"), at("b")))).alias("one"))
    pairs = pairs.select("region", "pair", F.col("one.comp").alias("comp"), F.col("one.chunk").alias("chunk"))
    return placed.hint("merge").join(pairs, ["region", "comp", "chunk"]).select(F.col("pair").alias("region"), "node", "comp")


def classes(docs: DataFrame, shingle: int = SHINGLE, like: tuple[int, int] = LIKE) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the least doc_id reachable over links."""
    rows = read(docs, shingle)
    live = not_lonely(rows, like)
    sets = sets_of(docs, live, shingle)
    roots = components(set_links(sets, like))
    nodes = rows.filter("n > 0").groupBy("same").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep"))
    linked = nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialise(linked.join(least, "root").select("same", "component_id"), "jaccard-named")
    dropped(live, sets)
    full = rows.select("doc_id", "n", "same").hint("merge").join(named, "same", "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
