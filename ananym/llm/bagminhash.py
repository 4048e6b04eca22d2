"""Near-duplicate documents by BagMinHash signatures of their word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ananym.llm.common import byte_slices, components, hash_words, local_roots, mix64, prepare_session, split_words, windows, written

SHINGLE = 5
LEAST = 0.8
SLOTS = 96
BAND = 4
LEADER_ROUNDS = 2
#: Most documents and bytes of one side of a block in which all pairs are compared.
BLOCK_DOCUMENTS = 2048
BLOCK_BYTES = 8 << 20
BLOCK_COLUMNS = 2048
#: Expected misses of a slot before the time limit: e^-6 per document; those documents go on with a doubled limit.
MARGIN = 6.0
_BASE = 0xA0761D6478BD642F
_LEVEL, _NEXT, _MARK = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text, hash, times), and where each text's begin (one more at the end).

    A text of fewer words than a shingle is one shingle; a text without words has none.
    """
    codes, words, bounds = split_words(texts)
    hashes = hash_words(words)[codes]
    counts = np.diff(bounds)
    starts = np.maximum(counts - SHINGLE + 1, 0)
    row = np.repeat(np.arange(len(counts)), starts)
    at = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(bounds[:-1], starts)
    found = windows(hashes, SHINGLE, _BASE)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        whole = []
        for i in short:
            h = np.uint64(counts[i])
            for x in hashes[bounds[i] : bounds[i + 1]]:
                h = mix64(np.array([h]) + x)[0]
            whole.append(h)
        row, found = np.concatenate((row, short)), np.concatenate((found, np.array(whole, np.uint64)))
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(row)))
    row, found = row[first], found[first]
    return row, found, times, np.searchsorted(row, np.arange(len(counts) + 1))


def signatures(row: np.ndarray, found: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """BagMinHash signatures (text, slot): equal in a slot with the probability of the weighted Jaccard similarity.

    Each shingle has independent Poisson processes over the weight intervals [0, 1), [1, 2), [2, 4), ..., each with a rate
    of its length. A point has a time, a place in the interval (it counts if that lies below the shingle's weight) and a
    slot; a slot keeps its earliest point. Processes are followed only up to a time by which all slots are filled.
    """
    out = np.full(n * SLOTS, np.inf)
    total = np.bincount(row, weights=times, minlength=n)
    limit = np.where(total > 0, SLOTS * (np.log(SLOTS) + MARGIN) / np.maximum(total, 1), 0)
    todo = total > 0
    levels = np.ceil(np.log2(np.maximum(times, 1))).astype(np.int64) + 1
    element = np.repeat(np.arange(len(row)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    rate = np.where(level == 0, 1.0, low)
    seed = mix64(found[element] + level.astype(np.uint64) * _LEVEL)
    text, weight = row[element], times[element]
    while todo.any():
        live = np.flatnonzero(todo[text])
        time, state = np.zeros(len(live)), seed[live]
        while len(live):
            state = mix64(state + _NEXT)
            uniform = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            time = time - np.log(uniform) / rate[live]
            going = time < limit[text[live]]
            live, time, state = live[going], time[going], state[going]
            mark = mix64(state ^ _MARK)
            place = low[live] + rate[live] * ((mark >> np.uint64(32)).astype(np.float64) * 2.0**-32)
            counts = place < weight[live]
            slot = ((mark & np.uint64(0xFFFFFFFF)) % np.uint64(SLOTS)).astype(np.int64)
            np.minimum.at(out, text[live[counts]] * SLOTS + slot[counts], time[counts])
        todo = todo & np.isinf(out.reshape(n, SLOTS)).any(axis=1)
        limit = limit * 2
    return out.reshape(n, SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each run of ``BAND`` slots."""
    parts = signature.view(np.uint64).reshape(len(signature), SLOTS // BAND, BAND)
    key = np.broadcast_to(np.arange(SLOTS // BAND, dtype=np.uint64), parts.shape[:2])
    for i in range(BAND):
        key = mix64(key * np.uint64(_BASE) + parts[:, :, i])
    return key


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in byte_slices(batch.column(3)):
            part = batch.slice(a, b - a)
            row, found, times, bounds = shingles(part.column(3))
            keys = band_keys(signatures(row, found, times, len(part)))
            flat = pa.array(keys.reshape(-1).view(np.int64))
            offsets = np.arange(len(part) + 1, dtype=np.int32) * keys.shape[1]
            bands = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(bounds[1:] == bounds[:-1]))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], bands], names=["id", "h1", "h2", "bands"])


def elements(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle multisets as sets, one after another, and where each text's begins: the k-th occurrence of a shingle is an element of its own."""
    _, found, times, bounds = shingles(texts)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    ends = np.concatenate(([0], np.cumsum(times)))
    return mix64(np.repeat(found, times) + nth.astype(np.uint64) * _LEVEL), ends[bounds]


def overlap(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of two columns of texts, row by row."""
    (x, xs), (y, ys) = elements(left), elements(right)
    out = np.zeros(len(left))
    for i in range(len(left)):
        a, b = x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]]
        if len(a) and len(b):
            both = np.sort(np.concatenate((a, b)))
            shared = int((both[1:] == both[:-1]).sum())
            out[i] = shared / (len(both) - shared)
    return out


def block_overlap(texts: pa.Array, side: np.ndarray) -> np.ndarray:
    """Similarities between the texts where ``side`` is false (rows) and true (columns), through products of 0/1 matrices."""
    found, starts = elements(texts)
    size = np.diff(starts)
    row = np.repeat(np.arange(len(size)), size)
    _, column, times = np.unique(found, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = np.flatnonzero(~side), np.flatnonzero(side)
    both = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_COLUMNS):
        a, b = np.searchsorted(column, (low, low + BLOCK_COLUMNS))
        part = np.zeros((len(size), BLOCK_COLUMNS), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        both += part[left] @ part[right].T
    return both / np.maximum(size[left][:, None] + size[right][None, :] - both, 1)


def _block_links(least: float):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block. Links between members with different roots are told as a spanning tree."""
        current, held = None, []

        def linked():
            block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids, roots, low, high, own = (np.asarray(block.column(c)).astype(np.int64) for c in ("id", "root", "low", "high", "own"))
            texts = block.column("text")
            if low[0] == high[0]:
                n = len(ids)
                likeness = block_overlap(pa.concat_arrays([texts, texts]), np.repeat([False, True], n))
                left = right = np.arange(n)
            else:
                likeness = block_overlap(texts, own == high)
                left, right = np.flatnonzero(own != high), np.flatnonzero(own == high)
            a, b = np.nonzero(likeness >= least)
            a, b = left[a], right[b]
            differ = roots[a] != roots[b]
            a, b = a[differ], b[differ]
            tree = local_roots(a, b, len(ids))
            moved = np.flatnonzero(tree != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[tree[moved]])], names=["a", "b"])

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("band", "low", "high")], axis=1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for begin, end in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))):
                if begin == end:
                    continue
                if tuple(keys[begin]) != current:
                    if held:
                        yield linked()
                    current, held = tuple(keys[begin]), []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield linked()

    return found


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts overlap enough."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(2)):
                part = batch.slice(a, b - a)
                yield part.select(["a", "b"]).filter(pa.array(overlap(part.column(2), part.column(3)) >= least))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return met.select("a", "b", "text_a", "text_b").mapInArrow(kept, "a long, b long").distinct()


def _compared(inside: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links between members of a band with different roots: blocks of the band meet each other, no pair is listed."""
    lengths = texts.select("id", F.octet_length("text").alias("bytes"))
    sizes = inside.join(lengths, "id").groupBy("band").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    chunks = F.ceil(F.greatest(F.col("n") / BLOCK_DOCUMENTS, F.col("bytes") / BLOCK_BYTES, F.lit(1))).cast("int").alias("chunks")
    sizes = written(sizes.select("band", chunks), "bag-blocks")
    own = F.pmod(F.xxhash64("id"), "chunks").cast("int")
    dealt = inside.join(sizes.hint("merge"), "band").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("band", "id", "root", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    blocks = dealt.join(texts.hint("merge"), "id").repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "id")
    return blocks.mapInArrow(_block_links(least), "a long, b long").distinct()


def _text_hashes(text: Column) -> tuple[Column, Column]:
    """Two hashes of a text, in which null isn't the empty text."""
    content = F.coalesce(text, F.lit(""))
    return F.when(text.isNull(), F.xxhash64(content, F.lit(1))).otherwise(F.xxhash64(content)), F.hash(content)


def near_duplicates(docs: DataFrame, least: float = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Groups of documents linked by a weighted Jaccard similarity of at least ``least`` between their shingle multisets.

    Equal texts are one class, represented by its least key. Classes that share a band of the signature are
    candidates. Within a band, everybody is first compared with a leader (another one in each of two rounds); links join
    into components. In bands that still hold several components all members meet in bounded blocks, where members of different components
    are compared by matrix products; tasks return spanning trees, never pairs. So a band of thousands of copies costs
    few comparisons of texts, and no link between components is left out.

    Returns one row per document: ``key``, ``class_id`` (least key with an equal text), ``component_id`` (least key that
    links reach) and ``kept`` (it is that key), with ``h1, h2`` (hashes of its text). Null texts are no duplicates of anything, null keys
    neither, and they are kept. Texts without words are duplicates of equal texts only. Texts of fewer than five words count as one shingle. Rows with one key count as one
    document when groups are formed. An empty table gives an empty table.
    """
    prepare_session(docs.sparkSession)
    h1, h2 = _text_hashes(F.col(text))
    rows = docs.select(F.col(key).cast("long").alias("id"), h1.alias("h1"), h2.alias("h2"), F.col(text).alias("text"))
    known = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    signed = written(known.mapInArrow(_bands, "id long, h1 long, h2 int, bands array<long>"), "bag-bands")
    classes = written(signed.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "bag-classes")
    banded = classes.select("id", F.explode("bands").alias("band"))
    busy = banded.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("band")
    busy = written(busy, "bag-busy")  # a table of its own, so that Spark can split a hot band of the join
    members = written(banded.join(busy.hint("merge"), "band").distinct(), "bag-members")
    wanted = classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "h1", "h2")
    # One row per class, whatever the times a row repeats; map tasks already leave one of their own.
    single = known.dropDuplicates(["id", "h1", "h2"])
    texts = written(single.join(wanted.hint("merge"), ["id", "h1", "h2"]).select("id", "text"), "bag-texts")

    roots = members.select(F.col("id").alias("node"), F.col("id").alias("root")).distinct()
    links = tried = None
    for turn in range(LEADER_ROUNDS + 1):
        grouped = members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        leader = F.min(F.struct(F.xxhash64("id", F.lit(turn)), "id", "root")).alias("leader")
        mixed = grouped.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), leader).where("least < most")
        mixed = written(mixed.select("band", "leader"), "bag-mixed")
        if mixed.isEmpty():
            break
        inside = grouped.join(mixed.hint("merge"), "band")
        if turn < LEADER_ROUNDS:
            met = inside.where(F.col("root") != F.col("leader.root"))
            pairs = met.select(F.least("id", "leader.id").alias("a"), F.greatest("id", "leader.id").alias("b")).distinct()
            pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "bag-pairs")
            tried = pairs if tried is None else tried.union(pairs)
            found = written(_verified(pairs, texts, least), "bag-links")
        else:
            found = written(_compared(written(inside.drop("leader"), "bag-inside"), texts, least), "bag-links")
        links = found if links is None else links.union(found)
        roots = components(links, "bag-groups")

    known_classes = classes.select("h1", "h2", F.col("id").alias("class_id")).join(roots.withColumnRenamed("node", "class_id"), "class_id", "left")
    joined = rows.drop("text").join(known_classes.hint("merge"), ["h1", "h2"], "left")
    class_id = F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", class_id))
    return joined.select(F.col("id").alias(key), class_id.alias("class_id"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), "h1", "h2")


def deduplicate(docs: DataFrame, least: float = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group, the one with the least key; rows that repeat in key and text become one row.

    Rows with a null key or a null text are all kept. An empty table stays empty.
    """
    # All columns travel in one struct, so that no name of theirs can clash.
    h1, h2 = _text_hashes(F.col(text))
    names = ["__id", "__h1", "__h2"]
    rows = docs.select(F.struct("*").alias("__row"), F.col(key).cast("long").alias("__id"), h1.alias("__h1"), h2.alias("__h2"))
    found = written(near_duplicates(docs, least, text, key), "bag-decisions").withColumnsRenamed({key: "__id", "h1": "__h1", "h2": "__h2"})
    gone = found.where(~F.col("kept")).select(names).distinct()
    twice = found.where(F.col("kept") & F.col("__id").isNotNull()).groupBy(names).count().where("count > 1").select(names)
    left = rows.join(gone, names, "left_anti")
    once = left.join(twice, names, "left_anti")
    again = left.join(twice, names, "left_semi").dropDuplicates(names)
    return once.unionByName(again).select("__row.*")
