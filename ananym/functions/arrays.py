"""Token-array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ananym.config import IGNORED_LABEL


def truncated(ids: Column, context_length: int) -> Column:
    """The first ``context_length`` ids."""
    return F.slice(ids, 1, context_length)


def chunked(ids: Column, context_length: int) -> Column:
    """Consecutive windows of exactly ``context_length`` ids; a shorter tail is dropped."""
    full = F.floor(F.size(ids) / context_length).cast("int")
    starts = F.sequence(F.lit(0), full - 1)
    windows = F.transform(starts, lambda i: F.slice(ids, i * context_length + 1, F.lit(context_length)))
    return F.when(full > 0, windows).otherwise(F.array().cast("array<array<int>>"))


def padded(ids: Column, width: Column, fill: int | Column) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fill), width - F.size(ids)))


def attention_mask(ids: Column, width: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), width - F.size(ids)))


def labels(ids: Column, width: Column, pad_id: int | Column) -> Column:
    """Ids as labels; padding, and any pad id in the row itself, is ignored by the loss."""
    own = F.transform(ids, lambda i: F.when(i == pad_id, F.lit(IGNORED_LABEL)).otherwise(i))
    return padded(own, width, IGNORED_LABEL)


def adjacent_pairs(symbols: Column) -> Column:
    """Each neighbouring pair of one-character symbols, overlaps included, as two-character strings."""
    n = F.size(symbols)
    heads = F.slice(symbols, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tails = F.slice(symbols, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(heads, tails, lambda a, b: F.concat(a, b))
