"""Concatenate-and-cut packing of tokenised documents into fixed windows.

Pass one tokenises every document once and writes its ids with the partition it came from and the count of
ids before it there. The partitions' totals (one row a partition) give each partition's first global offset;
pass two cuts the stream of ids at multiples of the window and emits one record a piece, so a document that
crosses a boundary has one record on each side.

Defined cases: a null or empty text is its end id alone; repeated rows are each packed; an empty table gives
an empty one; documents follow the order of the input's partitions, so results repeat for the same files.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

WINDOW = 4096
END_ID = 2
#: Entries of a worker's caches of space-separated chunks and of pieces; they are emptied when full.
CHUNKS, PIECES = 700_000, 500_000
#: Rows a task tokenises together.
TOGETHER = 64


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """Byte -> the printable character that stands for it in byte-level vocabularies: itself where printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


class _Memo(dict):
    """What ``make`` gives for a key, kept for short keys; emptied when full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(key) < 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Exact ids of whole texts with pieces cached.

    White space is never part of an id and no normalisation crosses it, so a text's ids are those of its
    space-separated chunks. A chunk of Latin-1 characters is split as the tokenizer's pattern says and its
    pieces go to the model one by one; any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.code = "H" if self.whole.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.letters = _byte_letters()
        self.chunks = _Memo(self._chunk, CHUNKS)
        self.pieces = _Memo(self._piece, PIECES)
        self.end = self._bytes([end_id])

    def _bytes(self, ids: list[int]) -> bytes:
        made = array(self.code, ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return self._bytes([t.id for t in self.model.tokenize(shown)])

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if chunk.isprintable() and max(chunk) < "\u0100" and "<|" not in chunk:
            low = chunk.lower()
            return self.pieces[low] if low.isalpha() else b"".join([self.pieces[p] for p in self.split(low)])
        return self._bytes(self.whole.encode(chunk, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """Little-endian ids of the text and the end id."""
        parts = text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ")
        return b"".join(map(self.chunks.__getitem__, parts)) + self.end


_encoders: dict[tuple, Encoder] = {}


def tokenised(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, before, n, ids): ids as little-endian bytes, before = ids before it in its partition; written once."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, end_id) not in _encoders:
            _encoders[path, end_id] = Encoder(path, end_id)
        coder = _encoders[path, end_id]
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(i, TOGETHER)
                ids = [coder.encode(t or "") for t in some.column(1).to_pylist()]
                n = [len(x) // coder.width for x in ids]
                starts = list(accumulate(n, initial=before))
                before = starts.pop()
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "part", "before", "n", "ids"]
                )

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialise(source.mapInArrow(run, "doc_id long, part int, before long, n long, ids binary"), "tokens")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece; with_ids adds its ids. sequence_length is the padded length of its sequence:
    the window, or for the last one its own length where that is a power of two."""
    spark, tokens = docs.sparkSession, tokenised(docs, path, end_id)
    totals = sorted((r.part, r.total) for r in tokens.groupBy("part").agg(F.sum("n").alias("total")).collect())  # one small row a partition
    firsts = list(accumulate((t for _, t in totals), initial=0))
    total = firsts[-1]
    rest = total % window
    last = (total // window, rest if rest & (rest - 1) == 0 else window) if rest else (-1, window)
    bases = spark.createDataFrame([(p, f) for (p, _), f in zip(totals, firsts)], "part int, base long")
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, at, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                cut = 0
                while cut < n:
                    sequence, offset = divmod(at + cut, window)
                    size = min(window - offset, n - cut)
                    piece = ids[cut : cut + size]
                    row = (doc, cut, size, zlib.crc32(piece.tobytes()), n, sequence, offset, last[1] if sequence == last[0] else window, piece)
                    for column, value in zip(out, row):
                        column.append(value)
                    cut += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if k == "ids" else pa.int64()) for k, c in zip(names, out)], names)

    return placed.mapInArrow(run, PIECE + ", ids array<long>" * with_ids)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
