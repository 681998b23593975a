"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in ascending order of doc_id. The permutation acts on Z_a x Z_b with a * b >= N and a * b - N < a,
so a walk hardly ever takes a second step. Position p of a row lies in shard p mod S at slot p div S: counts
differ by one at most, slots have no gaps, and both can be computed from the row number and back.

Defined cases: a null text has no bytes; null ids come first; rows with equal id are ordered by size and
checksum, and rows equal in those too are interchangeable; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import table, text_or_empty

SHARDS = 24
SEED = 20_240_601
ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift) as the round function."""
    z = x.astype(np.uint64) + np.uint64(key)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def _keys(seed: int, rounds: int) -> list[int]:
    return [(seed + (i + 1) * 0x9E3779B97F4A7C15) % (1 << 64) for i in range(rounds)]


def _sides(n: int) -> tuple[int, int]:
    a = int(np.ceil(np.sqrt(n)))
    return a, -(-n // a)


def _once(x: np.ndarray, a: int, b: int, keys: list[int], back: bool) -> np.ndarray:
    left, right = x // b, x % b
    for i in reversed(range(len(keys))) if back else range(len(keys)):
        m = a if i % 2 == 0 else b
        add = (_mixed(right if i % 2 == 0 else left, keys[i]) % np.uint64(m)).astype(np.int64)
        if i % 2 == 0:
            left = (left - add if back else left + add) % m
        else:
            right = (right - add if back else right + add) % m
    return left * b + right


def permuted(rows: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Positions of row numbers 0..n-1, or with ``back`` the row numbers of positions."""
    a, b = _sides(n)
    keys = _keys(seed, ROUNDS)
    out = _once(np.asarray(rows, np.int64), a, b, keys, back)
    while (outside := out >= n).any():  # the cycle of a number below n comes below n again
        out[outside] = _once(out[outside], a, b, keys, back)
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, row, shard, slot)."""
    text = text_or_empty().cast("binary")
    skinny = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows, n = numbered(skinny, "doc_id", "size", "text_crc32")

    @F.pandas_udf("long")
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(permuted(row.to_numpy(), n, seed))

    placed = rows.withColumn("position", position("row"))
    return placed.select("doc_id", "size", "text_crc32", "row", (F.col("position") % shards).cast("int").alias("shard"), F.expr(f"position div {shards}").alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
