"""Benchmark passages in documents: a prefix-filtered set join of shingles, in DataFrame functions only.

A window is ``window`` consecutive words of an item, or all of a shorter item. Windows are sets of shingles (runs of up to
``SHINGLE`` words). A document holds a window only if it holds all its shingles, so the prefix that must be shared is one
shingle, and the rarest in the corpus is the best choice.

1. Documents are scanned once for shingles of the benchmark; each is kept with the words around it.
2. Shingles are ordered by how often they were found. Each window's rarest one is its prefix; a window with a
   shingle that was never found occurs nowhere.
3. Found shingles meet the windows that have them as prefix. The shingle's offset in the window says where the window would
   start, which must lie in the document, and the document must have enough words after it.
4. The words there are compared with the window's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ananym.llm.common import prepare_session, written

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 5
# Shingles (16 bytes each in a hash table) and bytes of windows that every task may hold.
BROADCAST_SHINGLES = 2_000_000
BROADCAST_BYTES = 32 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = ["doc_id", "digest"]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_between(text: Column) -> Column:
    """Runs of letters and digits of ASCII and of any other characters; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), BETWEEN_WORDS)

    def without_empty_ends(parts: Column) -> Column:
        first, last = (F.when(F.element_at(parts, i) == "", 1).otherwise(0) for i in (1, -1))
        return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))

    # A lambda's variable holds the parts, so that the text is split once.
    return F.element_at(F.transform(F.array(parts), without_empty_ends), 1)


def _shingle(words: Column, at: Column, length: Column) -> Column:
    """The hash of the run of ``length`` words from ``at``; where the words end, the rest counts as nothing."""
    return F.xxhash64(length, *[F.get(words, at + i) for i in range(SHINGLE)])


def _shingles(words: Column, length: int) -> Column:
    """The hash of the run of ``length`` words from each word."""
    return F.transform(words, lambda word, at: F.xxhash64(F.lit(length), word, *[F.get(words, at + i) for i in range(1, length)]))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(window_id, item_id, words): windows of items; equal word sequences share the id."""
    words = items.select("item_id", F.explode(F.array(words_between(lower_ascii(F.col("text"))))).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    runs = words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, length))).alias("words"))
    return runs.select(F.sha2(F.concat_ws(" ", "words"), 256).alias("window_id"), "item_id", "words")


def _window_shingles(windows: DataFrame) -> DataFrame:
    """(window_id, words, length, shingle, offset) of distinct windows."""
    length = F.least(F.size("words"), F.lit(SHINGLE))
    offsets = F.sequence(F.lit(0), F.size("words") - length)
    shingles = F.transform(offsets, lambda o: F.struct(_shingle(F.col("words"), o, length).alias("shingle"), o.alias("offset")))
    distinct = windows.groupBy("window_id").agg(F.any_value("words").alias("words"))
    return distinct.select("window_id", "words", length.alias("length"), F.inline(shingles))


def _rows(docs: DataFrame) -> DataFrame:
    """Documents by key and digest of their text: what rows with both equal share."""
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")


def _found(docs: DataFrame, shingles: DataFrame, window: int, most: int) -> DataFrame:
    """(doc_id, digest, place, shingle, ahead, around): where documents hold a shingle of the benchmark.

    ``around`` holds ``ahead`` words before the place and up to ``window`` from it on.
    """
    lengths = sorted(r["length"] for r in shingles.select("length").distinct().collect())
    keys = shingles.select("shingle").distinct()
    if keys.count() <= most:
        keys = F.broadcast(keys)
    # The text is split once per row: generated columns are not copied into the expressions that use them.
    split = _rows(docs).select(*_ROW, F.explode(F.array(words_between(lower_ascii(F.col("text"))))).alias("words"))
    # One hash for each word and length; the place is the remainder.
    by_length = [_shingles(F.col("words"), n) for n in lengths]
    hashed = split.withColumn("shingles", F.concat(*by_length) if lengths else F.array().cast("array<long>"))
    # "outer" keeps Spark from hashing twice, to ask first whether there is anything; the join drops the rows it adds.
    placed = hashed.select(*_ROW, "words", F.posexplode_outer("shingles").alias("nth", "shingle"))
    place = F.col("nth") % F.size("words")
    ahead = F.least(place, F.lit(max(window - SHINGLE, 0)))
    around = F.slice("words", place - ahead + 1, ahead + window)
    return placed.join(keys, "shingle").select(*_ROW, place.alias("place"), "shingle", ahead.alias("ahead"), around.alias("around"))


def _prefixes(shingles: DataFrame, found: DataFrame) -> DataFrame:
    """(shingle, offset, window_id, words): each window under its rarest shingle; windows that can't occur are left out."""
    counts = found.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = shingles.join(counts, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = F.min(F.struct("n", "shingle", "offset")).alias("prefix")
    return ranked.groupBy("window_id").agg(rarest, F.any_value("words").alias("words")).where("prefix.n > 0").select(
        "prefix.shingle", "prefix.offset", "window_id", "words"
    )


def _spans(docs: DataFrame, windows: DataFrame, window: int, most_shingles: int, most_bytes: int) -> DataFrame:
    """(doc_id, digest, start, length, window_id) of each occurrence of a window."""
    shingles = written(_window_shingles(windows), "benchmark-shingles")
    found = written(_found(docs, shingles, window, most_shingles), "benchmark-found")
    prefixes = written(_prefixes(shingles, found), "benchmark-prefixes")
    size = prefixes.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "words")) + 256), F.lit(0))).first()[0]
    candidates = found.join(F.broadcast(prefixes) if size <= most_bytes else prefixes, "shingle")
    first, length = F.col("ahead") - F.col("offset"), F.size("words")
    fits = (first >= 0) & (F.size("around") >= first + length)
    same = F.slice("around", F.greatest(first, F.lit(0)) + 1, length) == F.col("words")
    start = (F.col("place") - F.col("offset")).cast("long").alias("start")
    return candidates.where(fits & same).select(*_ROW, start, length.cast("long").alias("length"), "window_id").distinct()


def occurrences(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, most_shingles: int = BROADCAST_SHINGLES, most_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(doc_id, digest, start, length, item_id): every place where ``docs(doc_id, text)`` hold a window of ``items(item_id, text)``.

    Places count words from 0; ``digest`` is the SHA-256 of the text. Rows equal in key and text, null keys among them, give one
    occurrence, and so do an item's equal windows at one place. Null texts and texts without words hold nothing and, as
    items, are found nowhere; empty tables give no rows. Other columns are ignored. Above the limits shingles or windows are joined by
    a shuffle instead of a broadcast, with the same rows.
    """
    prepare_session(docs.sparkSession)
    windows = written(_windows(items, window), "benchmark-windows")
    spans = _spans(docs, windows, window, most_shingles, most_bytes)
    return spans.join(windows.select("window_id", "item_id").distinct(), "window_id").drop("window_id").distinct()


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, most_shingles: int = BROADCAST_SHINGLES, most_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: its words, those inside occurrences of windows of ``items(item_id, text)``, and the items.

    Returns doc_id, n_words, n_hit, n_items (distinct keys of items with a window in the text), items_sha256 (of these keys
    as sorted strings, joined by commas) and contaminated. A null text has no words; items without words or with a null text
    are found nowhere. An item without a key marks words but is neither counted nor listed; items with one key count once.
    Every row of ``docs`` gives a row, repeated ones and those without a key too; an empty table gives none, and without items
    nothing is contaminated. Texts are compared whole, however long. Other columns are ignored.
    """
    prepare_session(docs.sparkSession)
    windows = written(_windows(items, window), "benchmark-windows")
    spans = _spans(docs, windows, window, most_shingles, most_bytes)
    end = F.col("start") + F.col("length")
    earlier = Window.partitionBy(*_ROW).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(earlier), F.lit(0))), F.lit(0))
    ids = F.array_sort(F.collect_set("window_id"))
    hit = spans.withColumn("covered", covered).groupBy(*_ROW).agg(F.sum("covered").alias("n_hit"), ids.alias("windows"))
    hit = written(hit.withColumn("signature", F.sha2(F.concat_ws(",", "windows"), 256)), "benchmark-hit")
    # Documents with the same windows share one list of items.
    signatures = hit.groupBy("signature").agg(F.any_value("windows").alias("windows"))
    members = signatures.select("signature", F.explode("windows").alias("window_id")).join(windows.select("window_id", "item_id").distinct(), "window_id")
    names = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    listed = members.groupBy("signature").agg(names.alias("names")).select(
        "signature", F.size("names").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "names"), 256).alias("items_sha256")
    )
    known = hit.select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), "n_hit", "signature").join(listed, "signature")
    rows = _rows(docs).select(*_ROW, F.size(words_between(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(known, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
