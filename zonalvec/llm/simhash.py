"""Near-duplicate groups by 64-bit SimHash and one-wildcard segment variants.

The fingerprint is cut into three segments. Fingerprints that differ in four bits or fewer have a segment
that differs in one bit at most (4 / 3 < 2), so both produce the same variant of it: the segment with one
bit position left out. Variants are joined on equality and the whole fingerprints are then compared.
Equal fingerprints are collapsed first, so copies never meet each other in the join.

Keys of 20 bits bring n fingerprints together about n / 2**20 at a time. For very many fingerprints ``links`` takes two of
five segments together (256 variants, keys of 24 bits or more), or three of six (640 variants, keys of 30 bits or more): of
four differences at most one lies in the two, or three, segments that have the fewest.

Defined cases: a null text has no words; no words give fingerprint zero, which links like any other; fewer
than four words are one shingle; repeated rows share a fingerprint; rows with a null doc_id keep a
fingerprint and take part, the component of a group of nothing but null ids is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Segments, and how many of them make a key together.
SEGMENTS, TOGETHER = 3, 1


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_BYTE_OFFSET = np.arange(8, dtype=np.int64) * 256


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of fewer words the hash of all."""
    import xxhash

    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))).tolist()
    starts = [0, *(e + 1 for e in ends[: -shingle])]
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])), np.uint64, len(starts))


def _majority(hashes: np.ndarray) -> int:
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_OFFSET).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of every shingle's XXH64, repeats included; as an unsigned number."""
    words = words_of(text)
    return _majority(_hashes(words, shingle)) if words else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _masks(segments: int, together: int) -> list[int]:
    """The bits of every choice of segments, as signed longs."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    bits = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(segments)]
    chosen = [sum(c) for c in combinations(bits, together)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def variants(fps: DataFrame, segments: int = SEGMENTS, together: int = TOGETHER) -> DataFrame:
    """For each choice of segments (c) and each of its bits (w) a row of a fingerprint: key is the choice without that bit."""
    parts = [F.struct(F.lit(c).cast("short").alias("c"), F.lit(w).cast("short").alias("w"), F.lit((m & ~(1 << w) & (1 << 64) - 1) - ((m & ~(1 << w) & (1 << 64) - 1) >> 63 << 64)).alias("m"))
             for c, m in enumerate(_masks(segments, together)) for w in range(64) if m >> w & 1]
    return fps.select("fp", F.explode(F.array(*parts)).alias("v")).select("fp", "v.c", "v.w", F.col("fp").bitwiseAND(F.col("v.m")).alias("key"))


def _first_shared(x: Column, masks: list[int]) -> Column:
    """The one variant (c * 64 + w) under which a pair is reported: of the first choice with at most one difference."""
    out = F.lit(-1)
    for c, m in reversed(list(enumerate(masks))):
        part, least = x.bitwiseAND(F.lit(m)), (m & -m).bit_length() - 1
        out = F.when(F.bit_count(part) == 0, 64 * c + least).when(F.bit_count(part) == 1, 64 * c + F.bit_count(part - F.lit(1))).otherwise(out)
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, together: int = TOGETHER) -> DataFrame:
    """(a, b): pairs of different fingerprints at max_bits or fewer; each once."""
    if together * (max_bits // segments) + max(0, together - (segments - max_bits % segments)) > 1:
        raise ValueError(f"{together} of {segments} segments can have more than one of {max_bits} differences")
    # Spark takes a table of variants for as small as the fingerprints it comes from, so it is told not to broadcast it;
    # both sides keep the same columns, and so they share one exchange.
    v = variants(fps, segments, together).hint("merge")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.w") == F.col("b.w")) & (F.col("a.c") == F.col("b.c"))
    once = F.col("a.c").cast("int") * 64 + F.col("a.w") == _first_shared(x, _masks(segments, together))
    return v.alias("a").join(v.alias("b"), same & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= max_bits) & once).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the least doc_id reachable over links."""
    fps = materialise(fingerprints(docs), "simhash")
    groups = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-groups")
    pairs = links(groups)
    roots = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    linked = groups.join(roots, groups.fp == roots.u, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = linked.join(linked.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D separate


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
