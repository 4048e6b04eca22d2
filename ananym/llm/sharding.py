"""Sharding by a permutation of row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ananym.llm.common import hash_order, mix64, prepare_session, running_totals, spread, written

ROUNDS = 6
LAW = "rows"


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A seeded bijection of 0..n-1.

    A balanced Feistel network permutes the next power of four; numbers that land at or above ``n`` are walked along
    their cycle until they come back. On average fewer than four walks are needed.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        return (left << half) | right

    out = network(numbers.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = network(out[outside])
    return out.astype(np.int64)


def permuted(number: Column, n: int, seed: int) -> Column:
    """``permute`` as a column; ``n`` is the number of rows."""

    @F.pandas_udf("long")
    def shuffled(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    return shuffled(number)


def shard_rows(docs: DataFrame, n_shards: int, seed: int = 0, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Deal all rows to shards in a reproducible random order.

    Rows get global numbers in hash order of key and content; the permuted number ``p`` gives shard ``p mod n_shards`` and slot
    ``p div n_shards``. So row counts of shards differ by one at most, slots have no gaps, and place and number can each be
    computed from the other. Returns ``keep`` (the key by default) with ``size`` (UTF-8 bytes plus 16), ``text_crc32``,
    ``law``, ``shard``, ``slot`` and ``grown_shard`` (null: the law ``rows`` does not say where rows go when a shard is added).
    A null text counts as empty. Rows with equal or null keys are dealt like others; rows equal in all columns used
    are interchangeable. An empty table gives an empty table.
    """
    prepare_session(docs.sparkSession)
    keep = keep or [key]
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(hash_order(F.col(key)).alias("__id"), (F.octet_length(content) + 16).cast("long").alias("__size"), F.crc32(content).alias("__crc"), F.lit(1).alias("__one"), *keep)
    # The checksum's 32 bits are spread evenly, so they cut rows of a hot key; equal rows are cut by a number of their own.
    cuts = {"__content": F.shiftleft(F.col("__crc").cast("long"), 28), "__rest": spread("__size", *keep), "__salt": spread(F.monotonically_increasing_id())}
    rows = written(rows.withColumns(cuts), "shard-rows")
    n = rows.count()
    numbered = running_totals(rows, [], ["__id", "__content", "__rest", "__salt"], "__one", n, "__number")
    dealt = numbered.withColumn("__p", permuted(F.col("__number"), n, seed))
    return dealt.select(
        *keep,
        F.col("__size").alias("size"),
        F.col("__crc").cast("long").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        (F.col("__p") % n_shards).cast("int").alias("shard"),
        F.expr(f"__p div {n_shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
