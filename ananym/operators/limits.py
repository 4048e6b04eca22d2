"""Limits, samples and splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ananym.functions.hashing import below_fraction, seeded_hash
from ananym.operators.order import nth_in_order, up_to

TRAIN = "train"
VALID = "valid"


def _unique_at(df: DataFrame, chosen: Column, n: int) -> Column:
    """``chosen``, checked to hold for ``n`` rows: more mean that several rows share the last key."""
    found = df.where(chosen).count()
    if found != n:
        raise ValueError(f"{found} rows instead of {n}: keys repeat; give rows unique keys first (sources.corpus.store_with_keys)")
    return chosen


def take_first(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The first ``n`` rows by a unique key of any type that Spark orders; a null or repeated key is an error.

    The n-th key is found by counting over the key column, so that neither many rows nor long texts
    meet in one task; the rows are then a filter on that key, which reaches the file scan.
    """
    if n < 1:
        return df.where(F.lit(False))
    last = nth_in_order(df, [F.col(key)], n)
    return df if last is None else df.where(_unique_at(df, up_to([F.col(key)], last), n))


def take_any(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows."""
    return df.limit(n)


def row_at(df: DataFrame, i: int, key: str = "doc_id") -> DataFrame:
    """The row with index ``i`` (from 0) by a unique key; empty if there is none."""
    found = nth_in_order(df, [F.col(key)], i + 1)
    return df.where(F.lit(False)) if found is None else df.where(_unique_at(df, F.col(key) == found[0], 1))


def first_by_hash(df: DataFrame, n: int, seed: int, key: str) -> Column:
    """True for the ``n`` rows that come first by seeded hash; found over the key column alone."""
    if n < 1:
        return F.lit(False)
    keys = [seeded_hash(seed, F.col(key)), F.col(key)]
    last = nth_in_order(df, keys, n)
    return F.lit(True) if last is None else _unique_at(df, up_to(keys, last), n)


def random_rows(df: DataFrame, k: int, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """``k`` rows picked by seeded hash, always within range."""
    return df.where(first_by_hash(df, k, seed, key))


def present(key: str) -> Column:
    """The key, or an error where it is null."""
    return F.coalesce(F.col(key), F.raise_error(F.lit(f"a row has no {key}; give rows keys first (sources.corpus.store_with_keys)")))


def sample_rows(df: DataFrame, fraction: float, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """About ``fraction`` of the rows, chosen by the hash of the key: no shuffle, and stable as rows are added.

    A row without a key is an error when it is read.
    """
    return df.where(below_fraction(seeded_hash(seed, present(key)), fraction))


def split_exact(df: DataFrame, test_size: float, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """Add ``split``: exactly ``ceil(test_size * rows)`` rows are ``valid``, the rest ``train``.

    Valid rows are the first by seeded hash. Finding the last of them takes two small jobs over the key
    column; the split itself is then a comparison with that row, so documents are not shuffled.
    """
    valid = first_by_hash(df, math.ceil(test_size * df.count()), seed, key)
    return df.withColumn("split", F.when(valid, VALID).otherwise(TRAIN))


def split_hash(df: DataFrame, test_size: float, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """Add ``split`` by hash threshold: size only about ``test_size``, but each row decides alone.

    Needs no counting, works on streams, and rows keep their split when others are added.
    """
    valid = below_fraction(seeded_hash(seed, present(key)), test_size)
    return df.withColumn("split", F.when(valid, VALID).otherwise(TRAIN))
