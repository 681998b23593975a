"""One document of each near-duplicate group: SimHash by deletion variants, and an exact join for what it leaves.

Documents link when their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Sets with too many shingles of their own have no
link and are done at once (see ``jaccard``). The others get a SimHash of their shingles; fingerprints of four differing bits or fewer are found by
one-wildcard segment variants, and each document is compared with the first one of its fingerprint's component: that settles most groups
at the cost of one comparison a document. Texts at 0.8 differ in about ten of 64 bits, though, which deletion variants of few segments
don't reach and those of many segments bring nearly all texts together for. So the Jaccard join goes through all sets that may have a link, and
skips the pairs that are known to hang together. It is exact: no bucket, size or distance in bits drops a pair.

Kept is the row of the least id, nulls last; of equal ids that of the least digest of the text, and of equal texts that of the least hash of
all columns. So what is kept does not depend on the order of rows. Defined cases: texts without words (null or empty) are one group;
repeated rows are one group; all columns are kept; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard, simhash
from .common import dropped, materialise
from .components import components

SHINGLE, LIKE = 5, (4, 5)
#: A third of all hashes is looked at for lonely shingles: at a similarity of 0.8 a set may have a fifth of its shingles for itself.
PART = 3


def set_fingerprints(sets: DataFrame) -> DataFrame:
    """(node, fp): the SimHash of the shingles of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash._majority(np.frombuffer(s.as_py(), np.uint64)) for s in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["node", "fp"])

    return sets.select("node", "s").mapInArrow(run, "node long, fp long")


def alike(pairs: DataFrame, sets: DataFrame, like: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) of nodes that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both * like[1] >= like[0] * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(c), F.col("s").alias(f"s_{c}")) for c in "uv")
    return pairs.join(one, "u").join(two, "v").select("u", "v", "s_u", "s_v").mapInArrow(run, "u long, v long")


def simhash_links(sets: DataFrame, like: tuple[int, int] = LIKE) -> DataFrame:
    """(u, v): each set with the first one of its fingerprint's component, where they link."""
    fps = materialise(set_fingerprints(sets), "near-fingerprints")
    roots = components(simhash.links(fps.select("fp").distinct()).select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = fps.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    first = materialise(placed.groupBy("root").agg(F.min("node").alias("v")), "near-first")
    found = materialise(alike(placed.join(first, "root").filter("node <> v").select(F.col("node").alias("u"), "v"), sets, like), "near-links")
    dropped(fps, first)
    return found


def groups(docs: DataFrame, key: str, shingle: int = SHINGLE, like: tuple[int, int] = LIKE) -> DataFrame:
    """(row, doc_id, text_key, root) of docs (key, doc_id, text): rows of equal root are one group; text_key is a digest of the text."""
    rows = jaccard.read(docs, shingle, PART, key)
    live = jaccard.not_lonely(rows, like, PART)
    sets = jaccard.sets_of(docs, live, shingle)
    near = simhash_links(sets, like)
    roots = materialise(components(near), "near-roots")
    known = roots.select(F.col("u").alias("node"), F.col("root").alias("comp")).union(roots.select("root", "root").distinct())
    every = components(near.union(jaccard.set_links(sets, like, known)))
    nodes = rows.groupBy("same").agg(F.min("row").alias("node"))
    named = materialise(nodes.join(every.withColumnRenamed("u", "node"), "node", "left").select("same", F.coalesce("root", "node").alias("root")), "near-named")
    dropped(live, sets, roots)
    return rows.select("row", "doc_id", "text_key", "same").hint("merge").join(named, "same").drop("same")


def one_per_group(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group, all columns kept."""
    whole = F.struct(*[docs[c] for c in docs.columns])
    rows = materialise(docs.select(whole.alias("row"), F.monotonically_increasing_id().alias("key"), F.xxhash64(whole).alias("mark")), "near-rows")
    found = materialise(groups(rows.select("key", "row.doc_id", F.col("row.text").cast("string").alias("text")), "key"), "near-groups")
    # Only groups of several rows have something to go.
    several = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("root")
    members = found.hint("merge").join(several, "root").withColumnRenamed("row", "key").join(rows.select("key", "mark"), "key")
    rank = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key", "mark", "key")
    members = materialise(members.select("root", "key", rank.alias("rank")), "near-members")
    least = members.groupBy("root").agg(F.min("rank").alias("least"))
    gone = materialise(members.hint("merge").join(least, "root").filter("key <> least.key").select("key"), "near-gone", instead_of=members)
    dropped(found)
    return rows.join(gone, "key", "left_anti").select("row.*")
