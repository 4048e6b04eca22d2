"""Positions in an order, without sorting the rows in one task.

Rows of a DataFrame have no order, so "the first n" and "the i-th" are defined by a unique key.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ananym.functions.hashing import hash_number

BOUNDS = 63
LAST_ROWS = 10_000
INDEX_BUCKET_DIGITS = 4


def up_to(keys: list[Column], last: Row) -> Column:
    """True for rows whose keys come no later in their order than those of ``last``."""
    *earlier, (key, bound) = zip(keys, last)
    inside = key <= bound
    for key, bound in reversed(earlier):
        inside = (key < bound) | ((key == bound) & inside)
    return inside


def _cell(keys: list[Column], bounds: list[Row], first: int = 0) -> Column:
    """How many of the ascending ``bounds`` lie before the keys, by halving."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(up_to(keys, bounds[middle]), _cell(keys, bounds[:middle], first)).otherwise(
        _cell(keys, bounds[middle + 1 :], first + middle + 1)
    )


def nth_in_order(df: DataFrame, keys: list[Column], n: int) -> Row | None:
    """The ``keys`` of the n-th row (from 1) in their order; None if there are fewer rows.

    Keys may be of any type that Spark orders; a null key is an error, as such rows have no place. Each pass counts the
    rows between a few bounds, which are keys drawn by hash, and keeps the range with the n-th row, until it is
    small enough for a plain top-n. Only the key columns are scanned and nothing is shuffled but counts.
    """
    keyed = df.select(*[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    own = [F.col(c) for c in keyed.columns]
    total, nulls = keyed.agg(F.count("*"), F.count_if(reduce(or_, [k.isNull() for k in own]))).first()
    if nulls:
        raise ValueError(f"{nulls} rows have no key; give rows keys first (sources.corpus.store_with_keys)")
    if n < 1 or n > total:
        return None
    inside, rest = total, keyed
    while inside > LAST_ROWS:
        drawn = rest.orderBy(F.xxhash64(*own), *own).limit(BOUNDS).distinct().orderBy(*own).collect()
        counts = {r["cell"]: r["count"] for r in rest.groupBy(_cell(own, drawn).alias("cell")).count().collect()}
        cell = 0
        while n > counts.get(cell, 0):
            n -= counts.get(cell, 0)
            cell += 1
        if cell < len(drawn):
            rest = rest.where(up_to(own, drawn[cell]))
        if cell:
            rest = rest.where(~up_to(own, drawn[cell - 1]))
        if counts[cell] == inside:  # one key holds all rows that are left
            break
        inside = counts[cell]
    return rest.orderBy(*own).offset(n - 1).limit(1).first()


def indexed(df: DataFrame, digest: str, ties: list[str], index: str = "index", by: tuple[str, ...] = (), bucket: str | None = None) -> DataFrame:
    """Number rows from 0 in the order of a hash column, within each value of the few-valued columns ``by``.

    Rows are grouped by the first hex digits of the hash. A count per group (at most 65,536, so small
    enough to broadcast at any scale) gives each group its offset, and rows are ranked inside their
    group only. Hashes of unique keys spread evenly, so no group is hot. ``bucket`` keeps the group under that name.
    """
    bucketed = df.withColumn("__bucket", hash_number(F.col(digest), INDEX_BUCKET_DIGITS))
    counts = bucketed.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*by, "__bucket").orderBy(digest, *ties)
    numbered = (
        bucketed.withColumn("__rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), [*by, "__bucket"])
        .withColumn(index, (F.col("__offset") + F.col("__rank") - 1).cast("bigint"))
        .drop("__rank", "__offset")
    )
    return numbered.withColumnRenamed("__bucket", bucket) if bucket else numbered.drop("__bucket")


# --- a stored index of positions ------------------------------------------------------------------

RANGES_SCHEMA = "first_key {key}, last_key {key}, n bigint, before bigint"


def write_key_ranges(df: DataFrame, path: str, key: str = "doc_id", rows_per_range: int = 100_000) -> DataFrame:
    """Write once which ranges of a unique key hold how many rows, so that rows at given positions are found by reading their ranges.

    Keys alone are sorted into about ``rows / rows_per_range`` ranges; the table has a row for each. A null key is an error.
    """
    keys = df.select(F.col(key).alias("key"))
    total, nulls = keys.agg(F.count("*"), F.count_if(F.col("key").isNull())).first()
    if nulls:
        raise ValueError(f"{nulls} rows have no key; give rows keys first (sources.corpus.store_with_keys)")
    ranged = keys.repartitionByRange(max(1, -(-total // rows_per_range)), "key").select("key", F.spark_partition_id().alias("range"))
    counted = ranged.groupBy("range").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n"))
    earlier = Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("bigint").alias("before")
    counted.select("first_key", "last_key", "n", before).write.parquet(path)
    return read_key_ranges(df, path, key)


def read_key_ranges(df: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    return df.sparkSession.read.schema(RANGES_SCHEMA.format(key=df.schema[key].dataType.simpleString())).parquet(path)


def rows_at(df: DataFrame, ranges: DataFrame, positions: list[int], key: str = "doc_id", index: str = "position") -> DataFrame:
    """The rows at several positions (from 0) in the order of a unique key, with their position; positions past the end give none.

    ``ranges`` is what :func:`write_key_ranges` wrote for the same rows. The driver takes only the ranges that hold a position; their
    bounds are a filter that reaches the scan, and rows are ranked inside their range.
    """
    wanted = sorted({int(p) for p in positions if p >= 0})
    chosen = F.lit(False)
    for p in wanted:
        chosen |= (F.col("before") <= p) & (F.col("before") + F.col("n") > p)
    hit = ranges.where(chosen).orderBy("before").collect()
    inside, before = F.lit(False), F.lit(None).cast("bigint")
    for r in hit:
        here = F.col(key).between(r["first_key"], r["last_key"])
        inside, before = inside | here, F.when(here, F.lit(r["before"])).otherwise(before)
    if not hit:
        return df.withColumn(index, F.lit(None).cast("bigint")).where(F.lit(False))
    found = df.where(inside).withColumn("__before", before)
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__before").orderBy(key)) - 1
    return found.withColumn(index, place.cast("bigint")).where(F.col(index).isin(wanted)).drop("__before")
