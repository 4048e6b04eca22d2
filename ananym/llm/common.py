"""Shared pieces: words of Arrow batches, running totals without a hot window, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ananym.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 256
FAN_OUT = 64
TOP_BUCKETS = 2048
#: Ranges with more than this share of the rows are cut again by a further number.
CROWDED_RANGES = 4096
#: Natural numbers from here on share one range of ``running_totals``.
SMALL_NUMBERS = 1 << 20
SLICE_BYTES = 4 << 20


# --- session --------------------------------------------------------------------------------------


def prepare_session(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts and drop shuffle files once their query has ended."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- running totals -------------------------------------------------------------------------------


def _bucket_offsets(sums: DataFrame, by: list[str], n_buckets: int, starts: DataFrame | None = None) -> DataFrame:
    """Exclusive running total of ``__sum`` over ``__b`` within ``by``; windows see at most ``TOP_BUCKETS`` rows.

    ``starts`` gives the total (``__start``) at which each value of ``by`` begins; 0 without it.
    """
    if n_buckets <= TOP_BUCKETS:
        before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select(*by, "__b", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
        return offsets if starts is None else offsets.join(starts, by).select(*by, "__b", (F.col("__offset") + F.col("__start")).alias("__offset"))
    coarse = F.expr(f"__b div {FAN_OUT}")
    upper = sums.groupBy(*by, coarse.alias("__b")).agg(F.sum("__sum").alias("__sum"))
    upper = _bucket_offsets(upper, by, -(-n_buckets // FAN_OUT), starts).withColumnsRenamed({"__b": "__c", "__offset": "__base"})
    near = Window.partitionBy(*by, "__c").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.withColumn("__c", coarse).withColumn("__offset", F.coalesce(F.sum("__sum").over(near), F.lit(0)))
    return inside.join(upper, [*by, "__c"]).select(*by, "__b", (F.col("__offset") + F.col("__base")).alias("__offset"))


def hash_order(column: Column) -> Column:
    """The first 60 bits of a column's md5 as a number: a repeatable random order that any engine can rebuild."""
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def spread(*columns: Column | str) -> Column:
    """60 bits of Spark's own hash of some columns: an evenly spread number."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 4)


def running_totals(df: DataFrame, by: list[str], order: list[str], value: str, n_rows: int, out: str, small: frozenset[str] = frozenset(), starts: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the total of ``value`` over the rows before this one, in the order of ``order`` within ``by``.

    Order columns are evenly spread numbers of 60 bits (``hash_order``, ``spread``), or small natural numbers if named in
    ``small``; they and ``by`` must not be null, and the last should tell all rows apart. ``df`` is read several times and must be
    a written table. Rows fall into about ``n_rows / 256`` ranges of the first number; totals of ranges are summed up level by level, and
    only rows of one range and one ``by`` are ranked together. Ranges are even unless the number repeats: those with
    more than a 4,096th of the rows, of which there are at most 4,096, are not ranked but cut again, by the next number within
    equal values of this one. So neither a hot ``by`` value, nor a hot key, nor rows that repeat meet in one task.
    """
    first = order[0]
    if first in small:
        buckets = SMALL_NUMBERS
        bucket = F.least(F.col(first), F.lit(buckets - 1))
    else:
        buckets = max(1, math.ceil(n_rows / BUCKET_ROWS))
        # The number's upper 32 bits times the count of ranges stay within 63 bits.
        bucket = F.shiftright(F.shiftright(first, 28) * F.lit(buckets).cast("long"), 32)
    hashed = df.withColumn("__b", bucket.cast("long"))
    sums = written(hashed.groupBy(*by, "__b").agg(F.sum(value).alias("__sum"), F.count("*").alias("__rows")), "total-ranges")
    offsets = _bucket_offsets(sums, by, buckets, starts)
    crowded = sums.where(F.col("__rows") > max(4 * BUCKET_ROWS, n_rows // CROWDED_RANGES)).select(*by, "__b", "__rows")
    n_crowded = crowded.agg(F.sum("__rows")).first()[0] if len(order) > 1 else None
    # At most CROWDED_RANGES rows, as each stands for more than that share of the table.
    crowded = F.broadcast(crowded.drop("__rows"))
    ranked = hashed.join(crowded, [*by, "__b"], "left_anti") if n_crowded else hashed
    inside = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(value).over(inside), F.lit(0))
    ranked = ranked.join(offsets.hint("merge"), [*by, "__b"]).select(*df.columns, (F.col("__offset") + earlier).cast("long").alias(out))
    if not n_crowded:
        return ranked
    again = hashed.join(crowded, [*by, "__b"], "left_semi")
    before = Window.partitionBy(*by, "__b").orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    own = again.groupBy(*by, "__b", first).agg(F.sum(value).alias("__sum")).withColumn("__earlier", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    begun = own.join(offsets, [*by, "__b"]).select(*by, first, (F.col("__earlier") + F.col("__offset")).alias("__start"))
    deeper = running_totals(again.drop("__b"), [*by, first], order[1:], value, n_crowded, out, small, written(begun, "total-starts"))
    return ranked.unionByName(deeper.select(*df.columns, out))


# --- words of Arrow batches -----------------------------------------------------------------------


def byte_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text stands alone."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start = stop


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of texts, one after another, and where each text starts (one more at the end)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def tiles(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of a byte buffer as an Arrow array, without a copy."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def coded_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words (runs without ASCII white space) of each text.

    Returns a code per word in order, the distinct words as an Arrow array of bytes, and where each text's words start
    (one more at the end). Null texts have no words. ``lower`` maps A-Z to a-z first.
    """
    raw, starts = text_buffer(texts)
    if lower:
        upper = raw - np.uint8(65) < 26
        raw = raw + (upper.view(np.uint8) << 5)
    raw = np.ascontiguousarray(raw)
    space = (raw == 0x20) | (raw - np.uint8(9) < 5)
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1]
    heads = starts[:-1][starts[:-1] < starts[1:]]
    first[heads] = word[heads]
    begin = np.flatnonzero(first)
    bounds = np.searchsorted(begin, starts)
    if not len(begin):
        return np.zeros(0, np.int32), pa.array([], pa.binary()), bounds
    # The words' bytes, one word after another; the dictionary is in the order in which words first occur.
    last = word
    last[:-1] &= space[1:] | first[1:]
    end = np.flatnonzero(last) + 1
    edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(end - begin)))
    coded = tiles(raw[~space], edges).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary, bounds


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """``coded_words`` with the distinct words as a list of bytes."""
    codes, words, bounds = coded_words(texts, lower)
    return codes, words.to_numpy(zero_copy_only=False).tolist(), bounds


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of every run of ``length`` consecutive word hashes (doubling: runs of 2, 4, ... are combined)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    power, done, part = base, 0, hashes
    size = 1
    while size <= length:
        if length & size:
            out = out * np.uint64(power) + part[done : done + n]
            done += size
        if size * 2 <= length:
            part = part[:-size] * np.uint64(power) + part[size:]
            power = power * power % 2**64
        size *= 2
    return mix64(out)


def ranges(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of the word hashes in each range, by prefix sums over powers of an odd base."""
    steps = np.full(len(hashes) + 1, base, np.uint64)
    back = np.full(len(hashes) + 1, pow(base, -1, 2**64), np.uint64)
    steps[0] = back[0] = 1
    steps, back = np.multiply.accumulate(steps), np.multiply.accumulate(back)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * steps[:-1], dtype=np.uint64)))
    return mix64((sums[end] - sums[begin]) * back[begin])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


# --- connected components -------------------------------------------------------------------------


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number in each node's component, for links between 0..n-1."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], least)
        np.minimum.at(after, root[b], least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) of an undirected graph given as ``a``, ``b``: root is the smallest node that links reach.

    Every round takes the least root among a node's neighbours and then follows roots once, so stars need two
    rounds and paths a number that grows with the logarithm of their length. Each round is written to the shared folder.
    Least values are taken by grouped aggregation, so a node with many links isn't gathered.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-links")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")), f"{label}-roots")
    while True:
        near = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        # Both the node and the root it had take the least root seen: links between trees join whole trees.
        seen = near.join(roots, F.col("a") == F.col("node")).select("node", "root", F.least("near", "root").alias("least"))
        offers = seen.select("node", F.col("least").alias("to")).union(seen.select(F.col("root").alias("node"), F.col("least").alias("to")))
        hooked = offers.groupBy("node").agg(F.min("to").alias("root"))
        upper = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = hooked.join(upper, "root").select("node", F.col("above").alias("root"))
        after = written(jumped, f"{label}-roots")
        changed = after.join(roots.withColumnRenamed("root", "was"), "node").where(F.col("root") != F.col("was")).limit(1).count()
        roots = after
        if not changed:
            return roots
