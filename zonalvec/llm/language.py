"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: how often each byte followed the last 0 to 3 bytes in its training
texts. With method C, a context seen n times with q different bytes gives a seen byte c / (n + q) and escapes
with q / (n + q) to the next shorter context, in which the bytes already ruled out are excluded; below order 0
all 256 bytes are equally likely. The statistics are frozen, so a byte's code length depends on the last four bytes
alone, and a text's code length under each language is a sum over its grams of four bytes. The shortest code wins.

A language keeps the code lengths of the bytes it saw in each context and the cost of an escape from it, nothing for
what it did not see: the model grows with what the languages saw, not with their number times all contexts. A gram's
code lengths are found by going from order 0 up, adding escapes and replacing what was seen; a worker remembers the
grams it met in a table of ``SLOTS`` places for all languages together.

A text fits its language if its code is not longer than ``LOOSE`` times, or ``LOOSE_BITS`` more, than the mean code of
a byte of that language's training sample, whichever allows more; ``LOOSE_START`` bits are free, for short texts.
At sf0.1 the means are about 2 bits and held-out texts need at most 3.7; letters in no learned language need 8 and more.

Training texts: those with an id whose crc32 modulo 4 is not 2 and a language; at most about
``SAMPLE_TEXTS`` of each language, chosen by a hash of their ids. The counts of that sample, one row for each language and
gram seen, come to the driver, where the model is made once.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without a language are
scored but never learned from; without any training text every row is ``und``; ties go to the first language in
alphabetical order; repeated rows are each scored; texts are read whole, in pieces of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_id_fold, table

ORDER = 3
FOLDS, HELD_OUT = 4, 2
SAMPLE_TEXTS = 1500
#: Bytes scored at a time.
PIECE = 1 << 14
#: Code lengths (4 bytes each) that a worker remembers, over all languages.
SLOTS = 1 << 21
#: Grams that it remembers besides, because their places are taken; with more it forgets all.
OTHERS = 1 << 16
#: Longest texts count as this many bytes in the score, which would else be 0 or 1.
CERTAIN_BYTES = 64
#: How much longer than the training sample's the code of a text in its language may be.
LOOSE, LOOSE_BITS, LOOSE_START = 2.0, 2.0, 64.0

_LETTER = re.compile(r"[^\W\d_]")


def _grams(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, gram, count) of a batch: grams are the last four bytes, zeros before a text's first."""
    by: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        by.setdefault(lang, []).append(b"\0" * ORDER + text.encode())
    for lang, texts in by.items():
        grams = []
        for t in texts:
            b = np.frombuffer(t, np.uint8).astype(np.uint32)
            grams.append((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:])
        yield lang, *np.unique(np.concatenate(grams), return_counts=True)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all given rows of lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for lang, gram, n in _grams(batch.slice(i, 256)):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    pieces = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).filter("lang is not null and length(text) > 0")
    return pieces.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class _Sparse:
    """Values of some languages for some sorted keys."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        """parts: keys and values of each language."""
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.starts = np.append(first, len(keys))
        self.langs = np.repeat(np.arange(len(parts), dtype=np.int16), [len(k) for k, _ in parts])[order]
        self.values = np.concatenate([v for _, v in parts])[order].astype(np.float32)

    def entries(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``asked``, languages and values of all that is held for them."""
        at = np.searchsorted(self.keys, asked)
        known = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == asked)
        at = at[known]
        n = self.starts[at + 1] - self.starts[at]
        places = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(known, n), self.langs[places], self.values[places]


class Model:
    """Code lengths of every byte after every three bytes, for each language."""

    def __init__(self, languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        """gram: the last four bytes of a place in a text, as a number; n: how often it was seen in the language."""
        self.languages = languages
        self.mean = np.zeros(len(languages))  # bits a byte of the training sample, under its own language
        seen: list[list] = [[] for _ in range(ORDER + 1)]
        escapes: list[list] = [[] for _ in range(ORDER + 1)]
        for k in range(len(languages)):
            own, times = gram[lang == k].astype(np.int64), n[lang == k]
            before = None
            for order in range(ORDER + 1):
                keys, at = np.unique(own & (1 << 8 * (order + 1)) - 1, return_inverse=True)  # context and byte
                counts = np.bincount(at, times, len(keys))
                contexts, of = np.unique(keys >> 8, return_inverse=True)
                total, kinds = np.bincount(of, counts, len(contexts)), np.bincount(of, minlength=len(contexts))
                # Below order 0 each byte is alike; a byte seen in a context was seen in the shorter one too.
                lower = np.full(len(keys), 1 / 256) if before is None else before[1][np.searchsorted(before[0], keys & (1 << 8 * order) - 1)]
                left = np.maximum(1 - np.bincount(of, lower, len(contexts)), 1e-12)
                shares = counts / (total + kinds)[of]
                seen[order].append((keys, -np.log2(shares)))
                escapes[order].append((contexts, -np.log2(kinds / (total + kinds) / left)))
                before = keys, shares
            if len(own):
                self.mean[k] = np.average(-np.log2(before[1][np.searchsorted(before[0], own)]), weights=times)
        if languages:
            self.seen, self.escapes = [_Sparse(x) for x in seen], [_Sparse(x) for x in escapes]
        self._forget()

    def _forget(self) -> None:
        """Begin the table of known grams anew; without its arrays, so that a model is sent small."""
        self.bits = max(1, (SLOTS // max(1, len(self.languages))).bit_length() - 1)
        self.held, self.lengths, self.others = None, None, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": None, "lengths": None, "others": {}}

    def gram_lengths(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram under each language."""
        out = np.full((len(grams), len(self.languages)), 8, np.float32)
        for order in range(ORDER + 1):
            keys = grams & (1 << 8 * (order + 1)) - 1
            rows, langs, bits = self.escapes[order].entries(keys >> 8)
            out[rows, langs] += bits
            rows, langs, bits = self.seen[order].entries(keys)
            out[rows, langs] = bits
        return out

    def _slots(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)).astype(np.int64)

    def _met(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths of different grams that have no place in the table: remembered there, or apart where the place is taken."""
        known = [self.others.get(g) for g in grams.tolist()]
        new = [i for i, x in enumerate(known) if x is None]
        if new:
            own = grams[new]
            found, places = self.gram_lengths(own.astype(np.int64)), self._slots(own)
            free = self.held[places] == (places == 0)
            self.held[places[free]] = own[free]
            kept = self.held[places] == own
            self.lengths[places[kept]] = found[kept]
            for i, gram, row, k in zip(new, own.tolist(), found, kept):
                known[i] = row
                if not k:
                    self.others[gram] = row
        return np.stack(known)

    def code_lengths(self, text: bytes) -> np.ndarray:
        """Bits of the whole text under each language."""
        if self.held is None or len(self.others) > OTHERS:
            self._forget()
            self.held, self.lengths = np.zeros(1 << self.bits, np.uint32), np.zeros((1 << self.bits, len(self.languages)), np.float32)
            self.held[0] = 1  # place 0 is that of gram 0, and so 1 stands for nothing there
        padded, out = b"\0" * ORDER + text, np.zeros(len(self.languages))
        for i in range(0, len(text), PIECE):
            size = min(PIECE, len(text) - i)
            grams = np.ndarray((size,), ">u4", padded, i, (1,)).astype(np.uint32)
            slots = self._slots(grams)
            known = self.held.take(slots) == grams
            if not known.all():
                new, times = np.unique(grams[~known], return_counts=True)
                slots = slots[known]
                out += times @ self._met(new).astype(np.float64)
            out += np.ones(len(slots), np.float32) @ self.lengths.take(slots, axis=0)
        return out

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """The language with the shortest code, how far it leads (the posterior of a text of CERTAIN_BYTES at most), and whether the text fits it."""
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0, False
        raw = text.encode()
        whole = self.code_lengths(raw)
        bits = whole * (min(len(raw), CERTAIN_BYTES) / len(raw))
        best = int(np.argmin(bits))
        most = max(self.mean[best] * LOOSE, self.mean[best] + LOOSE_BITS) * len(raw) + LOOSE_START
        return self.languages[best], float(1 / np.exp2(bits[best] - bits).sum()), bool(whole[best] <= most)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the shortest code and its lead."""
        return self.judge(text)[:2]


def fit(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> Model:
    """The model, made once on the driver from the counts. Only rows of the training folds are read."""
    training = docs.filter((row_id_fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    rates = F.broadcast(training.groupBy("lang").agg(F.least(F.lit(1.0), sample_texts / F.count(F.lit(1))).alias("rate")))  # one row a language
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    got = count_grams(training.join(rates, "lang").filter(draw < F.col("rate"))).toArrow()
    languages = sorted(set(got["lang"].unique().to_pylist()))
    number = {x: i for i, x in enumerate(languages)}
    lang = np.fromiter(map(number.__getitem__, got["lang"].to_pylist()), np.int16, len(got))
    return Model(languages, lang, got["gram"].to_numpy(), got["n"].to_numpy())


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """-> row (struct of docs' columns), lang_pred, score, fits."""
    from pyspark.sql import types as T

    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fits", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.judge(t.as_py()) for t in batch.column(0).field("text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], ["row", "lang_pred", "score", "fits"])

    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).mapInArrow(run, schema)


def with_a_language(docs: DataFrame) -> DataFrame:
    """The documents that fit the language found in them; all columns kept."""
    return identify(docs).filter("fits").select("row.*")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select(F.col("row.doc_id").alias("doc_id"), (row_id_fold("row.doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
