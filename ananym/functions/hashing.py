"""Deterministic pseudo-random order: the md5 of a seed and a row key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRACTION_DIGITS = 15


def seeded_hash(*parts: Column | int) -> Column:
    """md5 over the parts joined by ``:``; the same on every engine that has md5."""
    columns = [(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts]
    # Only parts that may be null, which are left out, need the slower function.
    spaced = [x for c in columns for x in (F.lit(":"), c)][1:]
    return F.md5(F.coalesce(F.concat(*spaced), F.concat_ws(":", *columns)))


def hash_number(digest: Column, digits: int) -> Column:
    """The first hex digits of a digest as a number, in digest order."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def fraction_limit(fraction: float) -> str:
    """The first hex digits at which digests are no longer below ``fraction``; exact, as 60 bits hold any float's part of them."""
    return f"{int(fraction * 16.0**FRACTION_DIGITS):0{FRACTION_DIGITS}x}"


def below_fraction(digest: Column, fraction: float) -> Column:
    """True for about ``fraction`` of all digests."""
    if fraction >= 1:
        return F.lit(True)
    # The limit's digits decide; a digest that begins with them is longer and so not below.
    return digest < fraction_limit(max(fraction, 0.0))
