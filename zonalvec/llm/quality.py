"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

A text's terms are its pairs of neighbouring words, each word as its pattern: runs of small letters, of capitals and of digits, each sign as
itself, and a sign of its own for a word that repeats the one before it. So the terms don't depend on a language's vocabulary. They are hashed to
``TERMS`` numbers and weighted by tf-idf to unit length. A truncated singular value decomposition of the
labelled sample's matrix gives the latent space. The space is fitted once, on the driver, and its basis and the sample's vectors
(``DIMENSIONS`` values each) are sent to all tasks; every document's cosines to all of them are computed in blocks, and its score is the share of label 1 among the nearest
``NEIGHBOURS``, weighted by a power of the cosine.

The sample holds about ``SAMPLE_TEXTS`` labelled training documents at most, chosen by a hash of their ids;
training rows are those with crc32(id) modulo 5 other than 0. Only text is looked at. Terms are counted in the tasks, so
what comes to the driver is the terms that occur, ``TERMS`` at most, for a sampled id, however long its text is.

Defined cases: a text without any term or similarity gets the sample's share of label 1; so does every row when
nothing is labelled (0.5 then); equal texts get equal scores; ties of cosine at six decimals go to the
labelled document with the smaller id; rows with a null or unknown label are not learned from; repeated
labels of an id count once, as the largest; of rows that repeat a labelled id one text is learned from, that of the least
checksum; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_id_fold, table

FOLDS, HELD_OUT = 5, 0
SAMPLE_TEXTS = 2000
DIMENSIONS = 64
NEIGHBOURS = 7
SHARPNESS = 8
THRESHOLD = 0.3
#: Documents a task multiplies at a time.
BLOCK = 256
TERMS = 4096
#: Runs of a word that its pattern holds; bytes looked at together.
RUNS, PIECE = 6, 1 << 20


def _odd(n: int, seed: int) -> np.ndarray:
    """Odd factors for hashing."""
    return np.array([(0x9E3779B97F4A7C15 * (seed + k) % (1 << 64)) | 1 for k in range(1, n + 1)], np.uint64)


def _kinds() -> np.ndarray:
    """Of each byte: 0 for blanks, one kind each for small letters (with bytes of longer characters), capitals and digits; signs are themselves."""
    out = np.arange(256, dtype=np.uint64) + 8
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[97:123], out[128:], out[65:91], out[48:58] = 1, 1, 2, 3
    return out


_KIND, _AT_RUN, _AT_BYTE, _PAIR = _kinds(), _odd(RUNS, 1000), _odd(64, 2000), _odd(2, 3000)
_AGAIN = np.uint64(1)


def _places(first: np.ndarray, n: int) -> np.ndarray:
    """Places from 0 within the stretches that begin at ``first``."""
    return np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))


def _patterns(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of some bytes a number of its pattern and one of its bytes."""
    kind = _KIND[raw]
    inside = kind > 0
    begins = inside & np.r_[True, ~inside[:-1]]
    runs = inside & np.r_[True, kind[1:] != kind[:-1]]
    raw, words = raw[inside], np.flatnonzero(begins[inside])
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    whole = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * _AT_BYTE[_places(words, len(raw)) % 64], words)
    first = np.flatnonzero(begins[runs])
    place = _places(first, int(runs.sum()))
    shape = np.add.reduceat(np.where(place < RUNS, kind[runs] * _AT_RUN[np.minimum(place, RUNS - 1)], np.uint64(0)), first)
    return shape, whole


def features(text: str | None) -> np.ndarray:
    """Counts of the hashed pairs of neighbouring words' patterns; a text's first word is paired with nothing."""
    raw, out, at = np.frombuffer((text or "").encode(), np.uint8), np.zeros(TERMS, np.int64), 0
    before, word = np.uint64(0), np.uint64(0)
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):  # cut at a blank, if need be a later one
            blanks = np.flatnonzero(_KIND[raw[at:end]] == 0)
            end = at + int(blanks[-1]) + 1 if len(blanks) else at + next((PIECE + i for i in range(len(raw) - at - PIECE) if _KIND[raw[at + PIECE + i]] == 0), len(raw) - at)
        shape, whole = _patterns(raw[at:end])
        at = end
        if len(shape):
            shape = np.where(whole == np.r_[word, whole[:-1]], _AGAIN, shape)
            pairs = (np.r_[before, shape[:-1]] * _PAIR[0] ^ shape * _PAIR[1]) * _PAIR[0]
            out += np.bincount((pairs >> np.uint64(52)).astype(np.int64), minlength=TERMS)
            before, word = shape[-1], whole[-1]
    return out


def counted(texts: list[str | None]) -> np.ndarray:
    """The features of several texts."""
    counts = np.zeros((len(texts), TERMS), np.float32)
    for row, text in enumerate(texts):
        counts[row] = features(text)
    return counts


class Space:
    """The latent space of a labelled sample, and its documents in it."""

    def __init__(self, ids: list[int], counts: np.ndarray, labels: list[int], dimensions: int = DIMENSIONS):
        """counts: of terms, a row for each id."""
        order = np.argsort(ids, kind="stable")
        self.labels = np.array(labels, float)[order]
        self.prior = float(self.labels.mean()) if len(order) else 0.5
        if (np.diff(order) != 1).any():  # else they are in order, and are not copied
            counts = counts[order]
        self.idf = (np.log((len(order) + 1) / ((counts > 0).sum(0) + 1)) + 1).astype(np.float32)
        matrix = self._weighted(counts)
        # Left singular vectors from the small Gram matrix of the sample; then the right ones.
        values, vectors = np.linalg.eigh((matrix @ matrix.T).astype(np.float64))
        keep = [i for i in np.argsort(-values)[:dimensions] if values[i] > 1e-6]
        self.basis = (matrix.T @ vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        self.vectors = self._unit(matrix @ self.basis)

    @staticmethod
    def _unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(np.log1p(counts) * self.idf)

    def scores(self, texts: list[str | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        own = self._unit(self._weighted(counted(texts)) @ self.basis)
        cosine = np.round((own @ self.vectors.T).astype(np.float64), 6)
        k = min(neighbours, len(self.labels))
        ranked = cosine - np.arange(len(self.labels)) * 1e-10
        nearest = np.argpartition(-ranked, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, nearest, 1), 0) ** SHARPNESS
        total = weight.sum(1)
        votes = (weight * self.labels[nearest]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.round(np.where(total > 0, votes, self.prior), 6), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> Space:
    """The space of the bounded labelled sample."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    training = known.filter(row_id_fold("doc_id", FOLDS) != HELD_OUT)
    rate = min(1.0, sample_texts / max(1, training.count()))
    # A part of all 64-bit hashes, so that the sample's size holds for any number of labels.
    most = min((1 << 63) - 1, int(rate * (1 << 64)) - (1 << 63))
    chosen = training.filter(F.xxhash64("doc_id") <= F.lit(most)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                some = batch.slice(i, BLOCK)
                counts = counted(some.column(1).to_pylist())
                there = [np.flatnonzero(c) for c in counts]
                made = [[p.astype(np.int16).tobytes() for p in there], [c[p].tobytes() for c, p in zip(counts, there)]]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), some.column(3), *map(pa.array, made)], ["doc_id", "quality", "sum", "pairs", "counts"])

    found = texts.select("doc_id", "text", "quality", F.xxhash64("text").alias("sum")).mapInArrow(count, "doc_id long, quality int, sum long, pairs binary, counts binary")
    sample = found.groupBy("doc_id").agg(F.min(F.struct("sum", "quality", "pairs", "counts")).alias("s")).select("doc_id", "s.*").orderBy("doc_id").toArrow()
    counts = np.zeros((len(sample), TERMS), np.float32)
    for row, pairs, n in zip(counts, sample["pairs"], sample["counts"]):
        row[np.frombuffer(pairs.as_py(), np.int16)] = np.frombuffer(n.as_py(), np.float32)
    return Space(sample["doc_id"].to_pylist(), counts, sample["quality"].to_pylist())


def scored(docs: DataFrame, space: Space) -> DataFrame:
    """-> row (struct of docs' columns), score."""
    sent = docs.sparkSession.sparkContext.broadcast(space)
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                some = batch.slice(i, BLOCK)
                rows = some.column(0)
                yield pa.RecordBatch.from_arrays([rows, pa.array(sent.value.scores(rows.field("text").to_pylist()))], ["row", "score"])

    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).mapInArrow(run, schema)


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject; all columns kept."""
    return scored(docs, fit(docs, labels)).filter(F.col("score") >= THRESHOLD).select("row.*")


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), (row_id_fold("row.doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
