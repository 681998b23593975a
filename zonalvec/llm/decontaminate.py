"""Benchmark decontamination with one Aho-Corasick automaton over the items' word windows.

Texts are normalised to words (A-Z lower-cased; ASCII non-alphanumerics separate). Every window of ten
consecutive item words, or a whole shorter item, is a pattern over word numbers; a document is scanned once
and each occurrence is mapped back to character offsets of the original text.

An automaton takes about 75 bytes a node and has at most three nodes a word of each window. Items of more than
``BLOCK_NODES`` nodes together are therefore dealt to several automata, each within a worker's memory; the documents go
through them one after the other and the spans are merged. One automaton is the usual case.

Defined cases: null or wordless texts have no words and no hits; items with null id or null text are left
out; items that repeat count once by id; repeated documents are each judged; other columns are carried along.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, materialise, table

WINDOW = 10
#: Nodes of an automaton at most, about 300 MB of a worker.
BLOCK_NODES = 4_000_000

#: Digits of a word's number that a node is reckoned for: enough for 262,143 different words.
DIGITS = 3

_FIND = re.compile(WORD)
#: For UTF-8 bytes: A-Z lower-cased, other ASCII but digits and letters to blanks; bytes of longer characters stay.
_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
#: One automaton for each block and Python worker.
_built: dict[str, Windows] = {}


def ascii_lower(text: str) -> str:
    """A-Z lower-cased; the text's length stays the same."""
    return text.encode().lower().decode()


def words(text: str | None) -> list[bytes]:
    """The words in UTF-8."""
    return text.encode().translate(_BYTES).split() if text else []


class Windows:
    """The automaton over all windows of some items, and what each window belongs to.

    A word's number is spelt in digits of base 64 with a range of their own for each place, since a node's
    edges are searched one after the other; a node then has 64 edges at most, whatever the vocabulary.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                patterns.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.digits = max(1, -(-len(self.numbers).bit_length() // 6))
        self.least = min(map(len, patterns), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, who in patterns.items():
            self.automaton.add_word(self._spelt(np.array(key)), (len(key), frozenset(who)))
        if patterns:
            self.automaton.make_automaton()

    def _spelt(self, ids: np.ndarray) -> tuple[int, ...]:
        places = np.arange(self.digits)
        return tuple(((ids[:, None] >> 6 * places & 63) + 64 * places).ravel().tolist())

    def occurrences(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """-> words in the text, merged word spans [first, end) that windows cover, ids of the items they belong to."""
        own = words(text)
        spans, who = [], set()
        if not self.least or len(own) < self.least:
            return len(own), [], who
        ids = np.fromiter(map(self.numbers.get, own, repeat(0)), np.int64, len(own))
        # No window holds a word that no item has, so only runs between such words are scanned.
        cuts = np.r_[-1, np.flatnonzero(ids == 0), len(ids)]
        for k in np.flatnonzero(np.diff(cuts) > self.least):
            first = int(cuts[k]) + 1
            for last, (size, items) in self.automaton.iter(self._spelt(ids[first : cuts[k + 1]])):
                end = first + last // self.digits + 1
                spans.append((end - size, end))
                who |= items
        return len(own), merge(spans), who


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _offsets(text: str, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word spans as code point offsets of the original text."""
    at = [m.span() for m in _FIND.finditer(ascii_lower(text))]
    return [{"first": f, "end": e, "start_char": at[f][0], "end_char": at[e - 1][1]} for f, e in spans]


SPAN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first", "end", "start_char", "end_char")]))


def _blocks(items: DataFrame, window: int, block_nodes: int) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """Items in blocks of about block_nodes nodes (or one item), and whether a block is the last; one block's rows are held at a time."""
    kept = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).filter("i is not null and t is not null")
    count = F.regexp_count(F.lower("t"), F.lit(WORD)).cast("long")
    nodes = F.greatest(F.lit(1), count - window + 1) * F.least(count, F.lit(window)) * DIGITS
    n = max(1, -(-kept.agg(F.coalesce(F.sum(nodes), F.lit(0))).first()[0] // block_nodes))
    for b in range(n):
        yield [(r.i, r.t) for r in kept.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()], b == n - 1


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """-> row (struct of docs' columns), n_words, spans (words and original characters), items (ids, sorted as strings)."""
    spark = docs.sparkSession
    schema = T.StructType([
        T.StructField("row", docs.schema), T.StructField("n_words", T.LongType()), T.StructField("spans", SPAN), T.StructField("items", T.ArrayType(T.StringType())),
    ])
    whole = None
    state = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.lit(None).cast(SPAN).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for items_here, last in _blocks(items, window, block_nodes):
        sent = spark.sparkContext.broadcast(items_here)
        token = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, token=token) -> Iterator[pa.RecordBatch]:
            if token not in _built:
                _built.clear()
                _built[token] = Windows(sent.value, window)
            windows = _built[token]
            for batch in batches:
                n_words, spans, who = [], [], []
                for text, before, ids in zip(batch.column(0).field("text"), batch.column(1), batch.column(2)):
                    text = text.as_py()
                    n, here, found = windows.occurrences(text)
                    n_words.append(n)
                    if before.is_valid and (old := before.as_py()):
                        here = merge(here + [(s["first"], s["end"]) for s in old])
                        found |= set(ids.as_py())
                    spans.append(_offsets(text, here) if here else [])
                    who.append(sorted(found))
                types = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "end", "start_char", "end_char")]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, types), pa.array(who, pa.list_(pa.string()))], ["row", "n_words", "spans", "items"])

        out = state.mapInArrow(run, schema)
        if not last:
            whole = materialise(out, "decontaminate", instead_of=whole)
            state = whole.select("row", "spans", "items")
    return out


def hit_words():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no window of an item occurs; all columns kept."""
    return scan(docs, items).filter(F.size("spans") == 0).select("row.*")


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, table(spark, sf_dir, "benchmark")).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
