"""A reproducible shuffle into shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import in_order, share_package
from civicspark.llm.shingles import mix

ROUNDS = 6


def _half_bits(n: int) -> int:
    """Bits of each half of the smallest even-length number that holds 0 .. n - 1."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _pass(x: np.ndarray, bits: int, key: int, back: bool) -> np.ndarray:
    """One Feistel network over 2 * bits bits, or its inverse."""
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    for r in range(ROUNDS):
        number = ROUNDS - 1 - r if back else r
        secret = np.uint64((key * ROUNDS + number + 1) * 0x9E3779B97F4A7C15 % 2**64)
        if back:
            left, right = right ^ (mix(left ^ secret) & mask), left
        else:
            left, right = right, left ^ (mix(right ^ secret) & mask)
    return left << np.uint64(bits) | right


def permute(rows: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The place of each row number of 0 .. n - 1, or with ``back`` the row of each place.

    Numbers the network sends beyond n - 1 walk on along their cycle until they are inside;
    the network covers fewer than 4 n numbers, so a walk has few steps. Nothing is stored:
    any place is computed from n and the key.
    """
    bits = _half_bits(n)
    x = _pass(np.asarray(rows).astype(np.uint64), bits, key, back)
    outside = np.flatnonzero(x >= n)
    while len(outside):
        x[outside] = _pass(x[outside], bits, key, back)
        outside = outside[x[outside] >= n]
    return x.astype(np.int64)


def locate(row_no: int, n: int, shards: int, key: int = 0) -> tuple[int, int]:
    """(shard, slot) of a row number, without any table."""
    place = int(permute(np.array([row_no]), n, key)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int, key: int = 0) -> int:
    """The row number that stands in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, key, back=True)[0])


def shard(df: DataFrame, order: list[str], shards: int, key: int = 0) -> DataFrame:
    """``df`` with ``row_no``, ``shard`` and ``slot``; shards differ by one row at most.

    Rows are numbered in the order of ``order``; those equal in all of it may swap numbers.
    Each shard's slots run from 0 without a gap. Nulls come first in the order; an empty table
    stays empty. Key skew does not matter: every row has a number of its own.
    """
    share_package(df.sparkSession)
    numbered, n = in_order(df, *order)

    @F.pandas_udf("long")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, key))

    return (
        numbered.withColumn("_to", place("row_no"))
        .withColumn("shard", (F.col("_to") % shards).cast("int"))
        .withColumn("slot", F.expr(f"_to div {shards}"))
        .drop("_to")
    )
