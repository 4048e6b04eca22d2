"""Removal of repeated long passages by a compacted graph of word windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ananym.llm.common import byte_slices, hash_words, mix64, prepare_session, ranges, signed, split_words, windows, written

SPAN = 20
KEY_WORDS = 6
_CELL_BASE = 0xD6E8FEB86659FD93


class Windows:
    """Windows of ``span`` words in a batch of texts and their anchors.

    A window's anchor is the leftmost of its short word runs with the least hash. Equal windows have equal anchors
    at equal places, and neighbours mostly share theirs, so a repeated window is found through a much smaller set of anchors.
    """

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, span: int = SPAN, key_words: int = KEY_WORDS):
        self.key = windows(hashes, key_words, 0x9E3779B97F4A7C15)
        counts = np.maximum(np.diff(bounds) - span + 1, 0)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(bounds[:-1], counts)
        least, place = self.key, np.arange(len(self.key), dtype=np.int64)
        width, wanted = 1, span - key_words + 1
        while width < wanted:
            step = min(width, wanted - width)
            later = least[step:] < least[:-step]
            place = np.where(later, place[step:], place[:-step])
            least = np.where(later, least[step:], least[:-step])
            width += step
        self.anchor = place[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        changed = np.ones(len(self.anchor), bool)
        changed[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.row[1:] != self.row[:-1])
        #: The first window of each cell: neighbouring windows with one anchor.
        self.cell = np.flatnonzero(changed)
        self.cell_size = np.diff(np.append(self.cell, len(self.anchor)))

    def cell_hashes(self, hashes: np.ndarray, span: int = SPAN) -> np.ndarray:
        """A hash of each cell's words and its anchor's place in them."""
        begin = self.starts[self.cell]
        words = ranges(hashes, begin, begin + self.cell_size + span - 1, _CELL_BASE)
        return mix64(words + (self.anchor[self.cell] - begin).astype(np.uint64) * np.uint64(_CELL_BASE) + self.cell_size.astype(np.uint64))


def listed(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of numbers in lists (null: none) as arrays: their rows, first and second numbers. No Python object per pair."""
    flat = lists.flatten()
    sizes = np.asarray(pc.list_value_length(lists).fill_null(0))
    return np.repeat(np.arange(len(sizes)), sizes), *(np.asarray(c).astype(np.int64) for c in flat.flatten())


def covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in any of the ranges."""
    steps = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def _document_key(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """``__d, __t``: an order of documents by key (null last) and content; never null."""
    content = F.coalesce(F.col(text), F.lit(""))
    number = F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("__d")
    return docs.select(number, F.xxhash64(F.col(key).isNull(), content).alias("__t"), content.alias("__text"), *more)


def _cells(docs: DataFrame, span: int) -> DataFrame:
    """One row per cell of every document: its anchor, its hash, its place in the document."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(2)):
                part = batch.slice(a, b - a)
                codes, words, bounds = split_words(part.column(2))
                if len(codes) < span:
                    continue
                hashes = hash_words(words)[codes]
                w = Windows(hashes, bounds, span)
                rows = w.row[w.cell]
                nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(w.key[w.anchor[w.cell]]),
                        signed(w.cell_hashes(hashes, span)),
                        part.column(0).take(pa.array(rows)),
                        part.column(1).take(pa.array(rows)),
                        pa.array(nth.astype(np.int32)),
                        pa.array((w.starts[w.cell] - bounds[rows]).astype(np.int32)),
                        pa.array(w.cell_size.astype(np.int32)),
                    ],
                    names=["anchor", "cell", "d", "t", "nth", "start", "n"],
                )

    return docs.mapInArrow(found, "anchor long, cell long, d long, t long, nth int, start int, n int")


def _paths(occurrences: DataFrame, span: int) -> DataFrame:
    """Repeated cells joined along nonbranching paths.

    The graph has an edge per distinct repeated cell, from the words before it to the words after it. Where a cell always has one same successor,
    and that successor always the one same predecessor, both lie on one path. As cells of a path occur together everywhere, an
    occurrence of a path is a run of neighbouring cells of a document, named by the path's first cell.
    """
    in_document = Window.partitionBy("d", "t").orderBy("nth")

    def neighbour(side, step):
        near = F.when(side("nth").over(in_document) == F.col("nth") + step, F.struct(side("anchor").over(in_document), side("cell").over(in_document)))
        return near

    near = occurrences.withColumn("after", neighbour(F.lead, 1)).withColumn("before", neighbour(F.lag, -1))
    same = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    edges = near.groupBy("anchor", "cell").agg(
        F.count("*").alias("times"), same("after").alias("one_after"), same("before").alias("one_before"), F.min(F.struct("d", "t", "start")).alias("first")
    )
    edges = written(edges.where("times > 1"), "passage-graph")
    marked = occurrences.join(edges.hint("merge"), ["anchor", "cell"])
    marked = written(marked, "passage-edges")
    follows = (
        (F.lag("nth").over(in_document) == F.col("nth") - 1)
        & F.col("one_before")
        & F.coalesce(F.lag("one_after").over(in_document), F.lit(False))
    )
    breaks = marked.withColumn("path", F.sum(F.when(follows, 0).otherwise(1)).over(in_document))
    return breaks.groupBy("d", "t", "path").agg(
        F.min("start").alias("begin"),
        (F.max(F.col("start") + F.col("n")) + span - 1).alias("end"),
        F.min(F.struct("nth", "anchor", "cell", "first")).alias("head"),
    ).select("d", "t", "begin", "end", "head.anchor", "head.cell", "head.first")


def _edge_windows(docs: DataFrame, places: DataFrame, span: int) -> DataFrame:
    """The single windows of given cells: anchor, window hash and place."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(2)):
                part = batch.slice(a, b - a)
                codes, words, bounds = split_words(part.column(2))
                hashes = hash_words(words)[codes]
                w = Windows(hashes, bounds, span)
                rows, begin, n = listed(part.column(3))
                begin = begin + bounds[rows]
                chosen = covered(begin, begin + n, len(codes))[w.starts]
                starts, rows, anchors = w.starts[chosen], w.row[chosen], w.anchor[chosen]
                word = windows(hashes, span, _CELL_BASE)[starts] + (anchors - starts).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [signed(w.key[anchors]), signed(mix64(word)), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array((starts - bounds[rows]).astype(np.int32))],
                    names=["anchor", "word", "d", "t", "start"],
                )

    by_document = places.groupBy("d", "t").agg(F.collect_list(F.struct("start", "n")).alias("__cells"))
    picked = docs.join(by_document.hint("merge"), (docs["__d"] == by_document["d"]) & (docs["__t"] == by_document["t"]))
    return picked.select("__d", "__t", "__text", "__cells").mapInArrow(found, "anchor long, word long, d long, t long, start int")


def _distinct(docs: DataFrame) -> DataFrame:
    """One row per ``__d, __t``; only texts of rows that repeat are moved."""
    names = ["__d", "__t"]
    docs = docs.select(*names, "__text")
    twice = written(docs.groupBy(names).count().where("count > 1").select(names), "passage-twice")
    once = docs.join(twice, names, "left_anti")
    return once.unionByName(docs.join(twice, names, "left_semi").dropDuplicates(names))


def repeated_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Word ranges ``d, t, begin, end`` whose windows all start earlier as well; rows equal in ``__d`` and ``__t`` are one document."""
    docs = _distinct(docs)
    cells = written(_cells(docs.select("__d", "__t", "__text"), span), "passage-cells")
    # Written tables on both sides of a join let Spark split a hot key.
    anchors = cells.groupBy("anchor").agg(F.count("*").alias("times"), (F.min("cell") != F.max("cell")).alias("mixed")).where("times > 1")
    anchors = written(anchors.drop("times"), "passage-anchors")
    occurrences = written(cells.join(anchors.hint("merge"), "anchor"), "passage-repeats")
    paths = _paths(occurrences, span)
    whole = written(paths.where(F.struct("d", "t", F.col("begin").alias("start")) != F.col("first")).select("d", "t", "begin", "end"), "passage-spans")
    # Cells of one anchor that differ share windows at most in part; their first occurrences are compared window by window.
    firsts = occurrences.where("mixed").groupBy("anchor", "cell", "n").agg(F.min(F.struct("d", "t", "start")).alias("at")).select("at.*", "n")
    single = written(_edge_windows(docs, firsts, span), "passage-windows")
    place = F.struct("d", "t", "start")
    shared = single.groupBy("anchor", "word").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    shared = written(shared, "passage-shared")
    later = single.join(shared.hint("merge"), ["anchor", "word"]).where(place != F.col("first"))
    return whole.union(later.select("d", "t", F.col("start").alias("begin"), (F.col("start") + span).alias("end")))


def remove_repeats(docs: DataFrame, span: int = SPAN, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Remove every word that lies in a repeated window of ``span`` words, other than at the window's first occurrence.

    First is by key, then place in the document. Windows are judged on the input. Words are runs without ASCII white space,
    compared byte by byte through one 64-bit hash each, so two words that share a hash would count as equal. Returns ``keep`` with ``n_words, n_removed`` and ``kept``: the text
    without those words and the white space before each, other characters as they were. A null text has no words (``kept`` is null). Rows with the same
    key and text count as one document and get the same result; among rows with one key the content's hash decides
    the order; null keys come last. ``key`` is an integer column. An empty table gives an empty table.
    """
    prepare_session(docs.sparkSession)
    keep = keep or [key]
    schema = StructType([docs.schema[c] for c in keep]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    spans = repeated_spans(_document_key(docs, key, text), span)
    merged = written(spans.groupBy("d", "t").agg(F.collect_set(F.struct("begin", "end")).alias("__spans")), "passage-removals")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(rb"[^\x20\x09-\x0D]+")
        for batch in batches:
            for a, b in byte_slices(batch.column(0)):
                part = batch.slice(a, b - a)
                _, _, bounds = split_words(part.column(0))
                counts = np.diff(bounds)
                rows, begin, end = listed(part.column(1))
                all_gone = covered(begin + bounds[rows], end + bounds[rows], bounds[-1])
                removed = np.zeros(len(counts), np.int64)
                kept = part.column(0).to_pylist()
                for row in np.unique(rows).tolist():
                    gone = all_gone[bounds[row] : bounds[row + 1]]
                    removed[row] = gone.sum()
                    # A word that goes takes the white space before it along.
                    data, out, last = kept[row].encode(), [], 0
                    for drop, m in zip(gone, word.finditer(data)):
                        if not drop:
                            out.append(data[last if out or not last else m.start() : m.end()])
                        last = m.end()
                    kept[row] = b"".join([*out, data[last:]]).decode()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[2:], pa.array(counts, pa.int64()), pa.array(removed), pa.array(kept, pa.string())], names=schema.names
                )

    whole = _document_key(docs, key, text, F.col(text).alias("__own"), *[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)]).drop("__text")
    joined = whole.join(merged.hint("merge"), (whole["__d"] == merged["d"]) & (whole["__t"] == merged["t"]), "left")
    return joined.select("__own", "__spans", *[f"__keep{i}" for i in range(len(keep))]).mapInArrow(cut, schema)


def without_repeats(docs: DataFrame, span: int = SPAN, text: str = "text", key: str = "doc_id", length: str | None = None) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; ``length``, if given, is set to the characters left."""
    # All columns travel in one struct, so that no name of theirs can clash.
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.struct("*").alias("__row"))
    cut = remove_repeats(rows, span, "__text", "__key", ["__row"])
    own = {text: F.col("kept")} | ({length: F.length("kept").cast("long")} if length else {})
    return cut.select(*[own.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
