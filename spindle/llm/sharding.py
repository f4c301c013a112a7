"""Sharding by a Feistel permutation with cycle walking (operator 6).

Rows get gapless global numbers in the order of (id, size, checksum). A keyed
Feistel network over the next even power of two permutes these numbers; a value
outside 0..N-1 is permuted again until it falls inside (cycle walking), which
keeps it a bijection. Shard and slot follow from the permuted number alone:
shard = p mod shards, slot = p div shards. Counts are at most one apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.operators.order import numbered

from . import common

ROUNDS = 6
_M = (1 << 64) - 1


def _keys(seed: int) -> list[np.uint64]:
    out, x = [], seed & _M
    for _ in range(ROUNDS):
        x = (x + 0x9E3779B97F4A7C15) & _M
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
        out.append(np.uint64(((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M))
    return out


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _mix(half: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    z = (half ^ key) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(32))) & mask


def permute(numbers: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The permuted numbers of 0..n-1 (or, inverse, the row numbers of permuted ones)."""
    bits = _half_bits(n)
    mask, shift, keys = np.uint64((1 << bits) - 1), np.uint64(bits), _keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for key in reversed(keys) if inverse else keys:
            left, right = (right ^ _mix(left, key, mask), left) if inverse else (right, left ^ _mix(right, key, mask))
        return (left << shift) | right

    out = once(numbers.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():  # the cycle of each start leads back inside
        out[far] = once(out[far])
    return out.astype(np.int64)


def sharded(df: DataFrame, n_shards: int, order: list[str], seed: int) -> DataFrame:
    """df with shard and slot by the law `rows`; see shard_documents()."""
    saved = common.saved(df)  # the range shuffle reads it twice, once for its sample
    rows, n = numbered(saved, order)
    common.dropped(saved)

    @F.pandas_udf("long")
    def permuted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(permute(b.to_numpy(), n, seed))

    common.ready(df.sparkSession)
    p: Column = F.col("_p")
    return rows.withColumn("_p", permuted("row_no")).withColumn("shard", (p % n_shards).cast("int")).withColumn("slot", F.expr(f"_p div {n_shards}")).drop("_p")


def shard_documents(df: DataFrame, n_shards: int = 40, seed: int = 20_240_601, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard and row_no of every row.

    size is the UTF-8 bytes of the text (null: none) plus 16. The law is
    `rows`: counts of shards are at most one apart, slots gapless from 0. Null
    ids sort first; rows with equal ids sort by size, checksum and place, so
    the same table always gives the same shards up to rows that look alike.
    Only id, size and checksum are shuffled. An empty table gives no rows.
    """
    text = F.coalesce(common.quoted(text_col), F.lit(""))
    rows = df.select(common.quoted(id_col).alias("_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharded(rows, n_shards, ["_id", "size", "text_crc32"], seed)
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(common.table(spark, sf_dir, "documents"))
