"""Token arrays cut to a context length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananym.functions.arrays import chunked, truncated

TRUNCATE = "truncate"
CHUNK = "chunk"


def truncate_sequences(df: DataFrame, context_length: int, ids: str = "input_ids") -> DataFrame:
    """Keep every document, cut after ``context_length`` ids."""
    return df.withColumn(ids, truncated(F.col(ids), context_length))


def chunk_sequences(df: DataFrame, context_length: int, ids: str = "input_ids") -> DataFrame:
    """One row per full window of ``context_length`` ids, numbered within its document.

    Tails and documents below ``context_length`` give no row; windows never span documents.
    """
    others = [c for c in df.columns if c != ids]
    windows = F.posexplode(chunked(F.col(ids), context_length)).alias("chunk", ids)
    return df.where(F.size(ids) >= context_length).select(*others, windows)


def fit_context(df: DataFrame, context_length: int, mode: str, ids: str = "input_ids") -> DataFrame:
    """Cut by a named mode and record it, so the two kinds of table cannot be confused."""
    if mode == TRUNCATE:
        cut = truncate_sequences(df, context_length, ids).withColumn("chunk", F.lit(0))
    elif mode == CHUNK:
        cut = chunk_sequences(df, context_length, ids)
    else:
        raise ValueError(f"mode must be {TRUNCATE!r} or {CHUNK!r}, not {mode!r}")
    return cut.withColumns({"mode": F.lit(mode), "length": F.size(ids)})


def full_length_only(df: DataFrame, context_length: int, ids: str = "input_ids") -> DataFrame:
    """Drop sequences that do not fill the context."""
    return df.where(F.size(ids) == context_length)
