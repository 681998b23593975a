"""Ranked lexical search by presence masks.

Documents are read once: each becomes its number of terms and the occurrences of those terms that any item has, which is
written as an index. The corpus's counts and a term's document frequency come from the index. It is then gone through in blocks of
documents. For an item, every document of a block has a presence mask: bit i is set if it holds the item's i-th term. Documents of equal masks
form a group, and no document of a group scores more than the sum of the largest contributions, in the block, of the terms in its mask.
Groups are evaluated by descending bound until ten documents are held that score more than any group left; what a task holds of
earlier blocks counts too. So of most groups no document is scored, and each task sends at most ten documents an item.

Items are a query set and are sent to the tasks in blocks of ``BLOCK_TERMS`` terms; very many of them take several passes.

Defined cases: a null text and one without terms have none, and are not counted as documents; items with a null id, a null text or
without terms give no rows; of rows that repeat an item's id the least text counts; repeated document ids are ranked each for itself, a null id
after the others of its score; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table
from .decontaminate import words

TOP = 10
#: Terms of a block of items at most, and documents of a block.
BLOCK_TERMS = 1_000_000
BLOCK = 16_384

INDEX = "doc_id long, n long, terms binary, counts binary"


def item_blocks(items: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(item_id, terms) in blocks of about block_terms terms; one block is held at a time."""
    kept = items.filter("item_id is not null and text is not null").groupBy("item_id").agg(F.min(F.col("text").cast("string")).alias("text"))
    n = max(1, -(-(kept.agg(F.sum(F.length("text"))).first()[0] or 0) // (4 * block_terms)))
    for b in range(n):
        rows = kept.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).collect()
        yield [(r["item_id"], w) for r in sorted(rows, key=lambda r: str(r["item_id"])) if (w := words(r["text"]))]


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): a document's terms with repeats, and the numbers and occurrences of those in the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column(1):
                own = words(text.as_py())
                ids = np.fromiter(map(get, own, repeat(-1)), np.int64, len(own))
                found, occur = np.unique(ids[ids >= 0], return_counts=True)
                sizes.append(len(own))
                terms.append(found.astype(np.int32).tobytes())
                counts.append(occur.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


def document_frequencies(indexed: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term; one row a term of the items comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(terms, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=terms)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], ["term", "n"])

    out = np.zeros(terms, np.int64)
    for r in indexed.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


class Block:
    """The postings of a block of documents."""

    def __init__(self, ids: list[int | None], sizes: list[int], terms: list[bytes], counts: list[bytes], weights: np.ndarray, documents: int, length: int):
        self.ids = ids
        m = np.array([100 - 75 + 75 * n * documents // length for n in sizes], np.int64)  # as Python's numbers: they do not overflow
        term = np.frombuffer(b"".join(terms), np.int32)
        tf = np.frombuffer(b"".join(counts), np.int32).astype(np.int64)
        doc = np.repeat(np.arange(len(ids)), [len(t) // 4 for t in terms])
        part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        order = np.argsort(term, kind="stable")
        there, first = np.unique(term[order], return_index=True)
        ends = np.r_[first[1:], len(term)]
        self.postings = {int(t): (doc[order[a:b]], part[order[a:b]]) for t, a, b in zip(there, first, ends)}
        self.most = {t: int(p.max()) for t, (_, p) in self.postings.items()}

    def search(self, item: list[tuple[int, int]], best: list[tuple], top: int) -> list[tuple]:
        """The best (-score, no id, id) of those held and of this block. item: (term, repeats)."""
        asked = [(t, q) for t, q in item if t in self.postings]
        if not asked:
            return best
        masks = np.zeros((len(self.ids), -(-len(asked) // 64)), np.uint64)
        for i, (t, _) in enumerate(asked):
            masks[self.postings[t][0], i // 64] |= np.uint64(1 << i % 64)
        held = np.flatnonzero(masks.any(1))
        flat = masks[held, 0] if masks.shape[1] == 1 else np.ascontiguousarray(masks[held]).view(f"V{8 * masks.shape[1]}").ravel()
        _, one, group = np.unique(flat, return_index=True, return_inverse=True)
        distinct = masks[held[one]]
        bound = np.zeros(len(one), np.int64)
        for i, (t, q) in enumerate(asked):
            bound += (distinct[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.int64) * (q * self.most[t])
        ranked = np.argsort(-bound, kind="stable")
        docs = held[np.argsort(group, kind="stable")]
        ends = np.cumsum(np.bincount(group))
        at, step = 0, 16
        while at < len(ranked):
            least = -best[-1][0] if len(best) == top else 1
            some = [g for g in ranked[at : at + step] if bound[g] >= least]
            if not some:
                break
            members = np.sort(np.concatenate([docs[(ends[g - 1] if g else 0) : ends[g]] for g in some]))
            score = np.zeros(len(members), np.int64)
            for t, q in asked:
                where, part = self.postings[t]
                place = np.minimum(np.searchsorted(where, members), len(where) - 1)
                score += np.where(where[place] == members, part[place], 0) * q
            good = np.flatnonzero(score >= least)
            if len(good) > 4 * top:  # those below the last of the best scores cannot come in
                good = good[score[good] >= -np.partition(-score[good], top - 1)[top - 1]]
            best = sorted([*best, *((-int(score[j]), self.ids[members[j]] is None, self.ids[members[j]] or 0) for j in good)])[:top]
            at, step = at + step, step * 2
        return best


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[list]]:
    held: list[list] = [[], [], [], []]
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            for column, more in zip(held, batch.slice(i, size).columns):
                column += more.to_pylist()
            if len(held[0]) >= size:
                yield held
                held = [[], [], [], []]
    if held[0]:
        yield held


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents with a score above 0, equal scores by id."""
    spark, out = docs.sparkSession, None
    kind = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", items.schema["item_id"].dataType)])
    for asked in item_blocks(items, block_terms):
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, own in asked for w in own))}
        indexed = materialise(index(docs, vocabulary), "lexical-index")
        documents, length = indexed.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_frequencies(indexed, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        sent = spark.sparkContext.broadcast([sorted(Counter(vocabulary[w] for w in own).items()) for _, own in asked])

        def search(batches: Iterator[pa.RecordBatch], sent=sent, weights=weights, documents=documents, length=length) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple]] = [[] for _ in sent.value]
            for columns in _blocks(batches, block):
                here = Block(*columns, weights, documents, length)
                best = [here.search(item, held, top) for item, held in zip(sent.value, best)]
            rows = [(i, None if none else doc, -score) for i, held in enumerate(best) for score, none, doc in held]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

        found = indexed.filter("n > 0").mapInArrow(search, "item int, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(asked)], kind)
        one = first.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    return out


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
