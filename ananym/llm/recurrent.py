"""A gated recurrent language model: training in Spark tasks and complete-document scores."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ananym.llm.common import byte_slices, coded_words, mix64, prepare_session, written

#: Words the network tells apart; all others share one of ``RARE`` classes by their last two characters.
VOCABULARY = 4096
CLASSES = 64
RARE = 64
#: Most frequent words whose counts every task holds, so that with the rare classes 16 bits number them; counts of other words are joined.
HEAD = 65_536 - RARE
#: Most pairs of neighbouring words (of the ``HEAD`` ones) that the network's probabilities are interpolated with: the most frequent ones.
PAIRS = 1 << 21
PAIR_BASE = 1 << 16
#: Steps of the logarithm by which pairs are counted by frequency.
FREQUENCY_STEPS = 256
PAIR_TOKENS = 1 << 22
PAIR_ROWS = 100_000
#: Tokens whose pairs are added up together, for which their number is a bound.
PAIR_GROUP_TOKENS = 1 << 21
#: Words that a task may hold of the counts it joins; above it sorts them.
JOINED_WORDS = 1 << 20
WORD_ROWS = 50_000
HIDDEN = 16
WINDOW = 32
STREAMS = 512
BLOCK_TOKENS = 1 << 20
#: Shares of the training documents (in sixteenths) for the rounds between which models are averaged.
ROUNDS = (1, 3, 5, 7)
RATES = (0.02, 0.01, 0.006, 0.003)
AVERAGING_TASKS = 64
FLUSH_ROWS = 1 << 14
#: Rows whose gradients at the classes are summed up at once, and rows whose probabilities are worked out together: they stay in a core's cache.
CLASS_ROWS = 1 << 10
CACHE_ROWS = 1 << 8
#: Documents and bytes that are scored together: long ones leave fewer steps to few streams.
SCORE_DOCUMENTS = 4000
SCORE_BYTES = 8 << 20
END = ""
LOG10 = float(np.log(10))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 1, F.lit(False))


def rare_class(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % RARE


def rare_class_column(word: Column) -> Column:
    return (F.crc32(F.right(word, F.lit(2))) % RARE).cast("int")


# --- vocabulary -----------------------------------------------------------------------------------


@dataclass
class Lexicon:
    """What tasks know of the words: the network's words with their classes, and counts of frequent words."""

    number: dict[str, int]  # the network's words, by falling count; numbers above are rare classes
    head: dict[str, int]  # counts of frequent words, the network's words first and in their order
    word_class: np.ndarray  # of the network's words; ascending
    counts: np.ndarray  # of the network's words, then of rare classes
    rare_log: np.ndarray  # log10 of each rare class's total, smoothed
    total: int
    distinct: int

    @property
    def size(self) -> int:
        return len(self.number) + RARE

    @property
    def end(self) -> int:
        return self.number[END]

    @cached_property
    def place(self) -> dict[str, int]:
        """Codes of frequent words; the codes above are rare classes of all other words."""
        return {w: i for i, w in enumerate(self.head)}

    @cached_property
    def words(self) -> pa.Array:
        """Frequent words in the order of their codes."""
        return pa.array(list(self.head), pa.string())

    @cached_property
    def network_ids(self) -> np.ndarray:
        """What the network knows each code as."""
        size = len(self.number)
        return np.array([i if i < size else size + rare_class(w) for i, w in enumerate(self.head)] + [size + i for i in range(RARE)], np.int64)

    @property
    def base_log(self) -> float:
        """log10 of the smoothed total of all words."""
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))


def with_ends(codes: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """Codes of all tokens: each text's words, then ``end``."""
    return np.insert(codes.astype(np.int64), bounds[1:], end)


def before_each(tokens: np.ndarray, end: int) -> np.ndarray:
    """The token before each one; before a text stands an end, which is also what the text before it ends with."""
    return np.concatenate(([end], tokens[:-1])) if len(tokens) else tokens


def decoded(words: pa.Array) -> pa.Array:
    """Words of ``coded_words`` as strings; bytes that are no UTF-8 are replaced. None holds a line end."""
    try:
        return words.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array(b"\n".join(words.to_pylist()).decode(errors="replace").split("\n"), pa.string())


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over lower-cased words of whole texts and one end (the empty word) per document."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            for a, b in byte_slices(batch.column(0), SCORE_BYTES):
                part = batch.slice(a, b - a)
                codes, words, _ = coded_words(part.column(0), lower=True)
                times = np.bincount(codes, minlength=len(words)) if len(words) else np.zeros(0, np.int64)
                names = pa.concat_arrays([pa.array([END], pa.string()), decoded(words)])
                whole = pa.RecordBatch.from_arrays([names, pa.array(np.concatenate(([len(part)], times)).astype(np.int64))], names=["word", "n"])
                yield from (whole.slice(i, WORD_ROWS) for i in range(0, len(names), WORD_ROWS))

    return docs.select(text).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def read_lexicon(counts: DataFrame) -> Lexicon:
    """The bounded part of the counts that tasks hold: ``HEAD`` words and totals of rare classes."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(HEAD).collect()]
    # The end is always one of the network's words.
    if all(w != END for w, _ in head):
        ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        head = [*head[: HEAD - 1], (END, ends)]
    words = head[:VOCABULARY]
    if all(w != END for w, _ in words):
        end = next(x for x in head if x[0] == END)
        words = [*words[:-1], end]
        head = [*words, *[x for x in head[VOCABULARY - 1 :] if x is not end]]
    number = {w: i for i, (w, _) in enumerate(words)}
    own = np.array([n for _, n in words], np.float64)
    # Classes by shares of the total of square roots: frequent words stand in small classes.
    share = np.cumsum(np.sqrt(own + 0.5))
    word_class = np.minimum((share / share[-1] * CLASSES).astype(np.int64), CLASSES - 1)
    word_class = np.unique(word_class, return_inverse=True)[1]
    known = counts.groupBy(rare_class_column(F.col("word")).alias("rare")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(RARE), np.zeros(RARE)
    for r in known:
        n[r["rare"]], v[r["rare"]] = r["n"], r["v"]
    for w, c in words:
        n[rare_class(w)] -= c
        v[rare_class(w)] -= c > 0
    return Lexicon(number, dict(head), word_class, np.concatenate((own, n)), np.log10(n + 0.5 * (v + 1)), int(total), int(distinct))


def token_codes(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Codes of all tokens with ends, where each text's start (one more at the end), and numbers of the words and the words."""
    numbers, words, bounds = coded_words(texts, lower=True)
    names = decoded(words)
    place = pc.index_in(names, value_set=lexicon.words)
    found = place.fill_null(-1).to_numpy().astype(np.int64)
    # Words end alike far more often than they are alike.
    tails = pc.utf8_slice_codeunits(names.filter(place.is_null()), -2, None).dictionary_encode()
    rare = np.fromiter((len(lexicon.head) + rare_class(t) for t in tails.dictionary.to_pylist()), np.int64, len(tails.dictionary))
    if len(rare):
        found[found < 0] = rare[tails.indices.to_numpy()]
    codes = with_ends(found[numbers] if len(names) else numbers, bounds, lexicon.place[END])
    return codes, bounds + np.arange(len(bounds)), numbers, names


# --- pairs of frequent words ----------------------------------------------------------------------


@dataclass
class PairTable:
    """The share each frequent pair takes of the occurrences of its first word, and what is left to the network.

    With c the counts and d the discount, P(w | words before) = (c(v w) - d) / c(v), if the pair is here, + left(v) * P(w) by the network;
    ``left`` is 1 for words v that begin no pair, and such that all w add up to one.
    """

    key: np.ndarray  # of pairs, ascending
    share: np.ndarray
    left: np.ndarray  # by code

    def look_up(self, codes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """For each token the pair's share (0 if it isn't here) and what is left."""
        before = before_each(codes, end)
        left, share = self.left[before], np.zeros(len(codes), np.float64)
        near = np.flatnonzero(left < 1)
        if len(near):
            wanted = (before[near] * PAIR_BASE + codes[near]).astype(np.uint32)
            # In ascending order the search stays in one part of the table.
            order = np.argsort(wanted)
            near, wanted = near[order], wanted[order]
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            share[near] = np.where(self.key[at] == wanted, self.share[at], 0)
        return share, left.astype(np.float64)


def count_pairs(encoded: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``pair, n``: how often a frequent word's code follows another's, over all documents of ``_training_ids``; an end also stands before each text.

    Tasks count the pairs of some tokens and deal them to groups by a hash of the pair; one row holds a task's pairs of one group. There
    are as many groups as keep each to about ``PAIR_GROUP_TOKENS`` tokens' pairs, and no pair is more than one entry of a row.
    """
    groups = max(1, -(-lexicon.total // PAIR_GROUP_TOKENS))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def pairs() -> Iterator[pa.RecordBatch]:
            codes = np.concatenate(held).astype(np.int64)
            before = before_each(codes, lexicon.place[END])
            frequent = (codes < len(lexicon.head)) & (before < len(lexicon.head))
            found, n = np.unique((before * PAIR_BASE + codes)[frequent].astype(np.uint32), return_counts=True)
            group = pair_group(found, groups)
            order = np.argsort(group, kind="stable")
            found, n, edges = found[order], n[order].astype(np.int64), np.searchsorted(group[order], np.arange(groups + 1))
            for g in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[g], edges[g + 1])
                yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([found[own].tobytes()]), pa.array([n[own].tobytes()])], names=["group", "pairs", "n"])

        for batch in batches:
            for data in batch.column(0):
                held.append(np.frombuffer(data.as_py(), "<u2"))
                size += len(held[-1])
                if size >= PAIR_TOKENS:
                    yield from pairs()
                    held, size = [], 0
        if held:
            yield from pairs()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        rows = ((p.as_py(), m.as_py()) for batch in batches for p, m in zip(batch.column("pairs"), batch.column("n")))
        # Rows are added up whenever they hold as many entries as the sums so far, at least those of a group.
        while more := list(_up_to(rows, max(PAIR_GROUP_TOKENS, len(pairs)))):
            pairs = np.concatenate([pairs, *(np.frombuffer(p, np.uint32) for p, _ in more)])
            n = np.concatenate([n, *(np.frombuffer(m, np.int64) for _, m in more)])
            order = np.argsort(pairs, kind="stable")
            pairs, n = pairs[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
            pairs, n = pairs[first], np.add.reduceat(n, first)
        whole = pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], names=["pair", "n"])
        yield from (whole.slice(i, PAIR_ROWS) for i in range(0, len(pairs), PAIR_ROWS))

    parts = encoded.select("ids").mapInArrow(counted, "group long, pairs binary, n binary")
    return parts.groupBy("group").applyInArrow(added, "pair long, n long")


def pair_group(pairs: np.ndarray, groups: int) -> np.ndarray:
    """The group of each pair: evenly spread, whatever the pairs' words."""
    return ((mix64(pairs) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _up_to(rows: Iterator[tuple[bytes, bytes]], most: int) -> Iterator[tuple[bytes, bytes]]:
    """The next rows, until they hold ``most`` entries."""
    size = 0
    while size < most and (row := next(rows, None)):
        size += len(row[0]) // 4
        yield row


def read_pairs(pairs: DataFrame, lexicon: Lexicon, most: int = PAIRS) -> PairTable:
    """The most frequent pairs of a written ``count_pairs``, at most ``most``, with what they leave; equally frequent ones are all in or all out.

    The discount is Ney's, from how many pairs occur once and twice in the whole corpus.
    """
    frequency = F.floor(F.log2("n") * FREQUENCY_STEPS).cast("int")
    steps = {r["f"]: r["count"] for r in pairs.groupBy(frequency.alias("f")).count().collect()}
    once, twice = steps.get(0, 0), steps.get(FREQUENCY_STEPS, 0)
    discount = float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.5
    least, taken = max(steps, default=0) + 1, 0
    for f in sorted(steps, reverse=True):
        taken += steps[f]
        if taken > most:
            break
        least = f

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(c).tobytes()]) for c in batch.columns], names=["pair", "n"])

    rows = pairs.where(frequency >= least).select("pair", "n").mapInArrow(packed, "pair binary, n binary").collect()
    key, n = (np.frombuffer(b"".join(r[i] for r in rows), np.int64) for i in range(2))
    order = np.argsort(key)
    key, own = key[order], n[order] - discount
    counts = np.maximum(np.fromiter(lexicon.head.values(), np.float64, len(lexicon.head)), 1)
    first = key // PAIR_BASE
    left = 1 - np.bincount(first, weights=own, minlength=len(counts)) / counts
    return PairTable(key.astype(np.uint32), (own / counts[first]).astype(np.float32), np.concatenate((left, np.ones(RARE))).astype(np.float32))


# --- network --------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _blocks(x: np.ndarray) -> np.ndarray:
    """The last axis, of two gates and the new state, as three blocks."""
    return np.ascontiguousarray(np.moveaxis(x.reshape(*x.shape[:-1], 3, HIDDEN), -2, 0))


def _wide(h: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether logits ``h @ weights.T + bias`` may be too far from zero to be exponentiated as they are."""
    return h.size > 0 and float(max(h.max(), -h.min())) * float(np.abs(weights).sum(axis=1).max()) + float(np.abs(bias).max()) > 60


class Network:
    """Embeddings, one gated recurrent layer and a class-factored softmax.

    P(next) = P(class | state) * P(word | class, state); the classes of rare words hold no words here.
    """

    def __init__(self, lexicon: Lexicon):
        self.words, self.word_class = len(lexicon.number), lexicon.word_class
        self.classes = int(self.word_class[-1]) + 1
        self.edges = np.searchsorted(self.word_class, np.arange(self.classes + 1))
        self.class_of = np.concatenate((self.word_class, self.classes + np.arange(RARE)))
        random = np.random.default_rng(1)
        h = HIDDEN
        scale = lambda *shape: (random.normal(size=shape) / np.sqrt(h)).astype(np.float32)
        counts = lexicon.counts + 0.5
        by_class = np.bincount(self.class_of, weights=counts)
        self.p = {
            "embed": scale(lexicon.size, h),
            "input": scale(h, 3 * h),
            "state": scale(h, 3 * h),
            "bias": np.zeros(3 * h, np.float32),
            "to_class": scale(h, len(by_class)) * 0.1,
            "class_bias": np.log(by_class / by_class.sum()).astype(np.float32),
            "to_word": scale(self.words, h) * 0.1,
            "word_bias": np.log(counts[: self.words] / by_class[self.word_class]).astype(np.float32),
        }

    def pack(self) -> bytes:
        return np.concatenate([x.ravel() for x in self.p.values()]).astype(np.float32).tobytes()

    def unpack(self, data: bytes) -> None:
        flat, at = np.frombuffer(data, np.float32), 0
        for name, x in self.p.items():
            self.p[name] = flat[at : at + x.size].reshape(x.shape).copy()
            at += x.size

    def step(self, gates: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step from the input's share of the gates and the state before."""
        n = HIDDEN
        own = h @ self.p["state"]
        zr = _sigmoid(gates[:, : 2 * n] + own[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        new = np.tanh(gates[:, 2 * n :] + r * own[:, 2 * n :])
        return new + z * (h - new), z, r, new, own[:, 2 * n :]

    def advance(self, gates: np.ndarray, h: np.ndarray, out: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """``step`` into ``out``, from ``_blocks`` of the input's share and of the state's weights: what it works on lies in one piece."""
        own = h @ state
        zr = np.empty_like(gates[:2])
        np.add(gates[:2], own[:2], out=zr)
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr
        new = np.empty_like(r)
        np.multiply(r, own[2], out=new)
        new += gates[2]
        np.tanh(new, out=new)
        np.subtract(h, new, out=out)
        out *= z
        out += new
        return z, r, new, own[2]

    def losses(self, h: np.ndarray, target: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None, dict]:
        """ln P of targets; when learning also the gradient at ``h`` and at the output's parameters."""
        p, rows = self.p, np.arange(len(target))
        owner = self.class_of[target]
        wide = _wide(h, p["to_class"].T, p["class_bias"])
        out, d_h = np.empty(len(target), h.dtype), np.empty_like(h) if learn else None
        grads = {k: np.zeros_like(p[k]) for k in ("to_class", "class_bias", "to_word", "word_bias")} if learn else {}
        ones = np.ones(CLASS_ROWS, h.dtype)
        for a in range(0, len(target), CLASS_ROWS):
            at = slice(a, min(a + CLASS_ROWS, len(target)))
            local, own = rows[: at.stop - a], owner[at]
            logits, total = h[at] @ p["to_class"], np.empty(at.stop - a, h.dtype)
            for low in range(a, at.stop, CACHE_ROWS):
                near = slice(low - a, min(low + CACHE_ROWS, at.stop) - a)
                part = logits[near]
                part += p["class_bias"]
                if wide:
                    part -= part.max(axis=1, keepdims=True)
                chosen = part[rows[: len(part)], own[near]]
                np.exp(part, out=part)
                total[near] = part.sum(axis=1)
                out[at][near] = chosen - np.log(total[near])
            if learn:
                logits *= (1 / total)[:, None]
                logits[local, own] -= 1
                grads["to_class"] += h[at].T @ logits
                grads["class_bias"] += ones[: at.stop - a] @ logits
                d_h[at] = logits @ p["to_class"].T
        # Rows stand by class, so that each class works on a slice.
        order = np.argsort(owner.astype(np.int16), kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(self.classes + 1))
        back = np.empty_like(order)
        back[order] = rows
        order = order[: cuts[-1]]
        near, place = h.take(order, axis=0), target[order]
        gained, d_near = np.zeros(len(out), out.dtype), np.zeros_like(h) if learn else None
        wide = _wide(near, p["to_word"], p["word_bias"])
        for c in range(self.classes):
            at = slice(cuts[c], cuts[c + 1])
            low, high = self.edges[c], self.edges[c + 1]
            if at.start == at.stop or high - low == 1:
                continue
            scores = near[at] @ p["to_word"][low:high].T
            scores += p["word_bias"][low:high]
            if wide:
                scores -= scores.max(axis=1, keepdims=True)
            local, own = rows[: at.stop - at.start], place[at] - low
            gained[at] = scores[local, own]
            np.exp(scores, out=scores)
            total = scores.sum(axis=1)
            gained[at] -= np.log(total)
            if learn:
                scores *= (1 / total)[:, None]
                scores[local, own] -= 1
                grads["to_word"][low:high] = scores.T @ near[at]
                grads["word_bias"][low:high] = scores.sum(axis=0)
                d_near[at] = scores @ p["to_word"][low:high]
        out += gained.take(back)
        if learn:
            d_h += d_near.take(back, axis=0)
        return out, d_h, grads

    def gradients(self, ids: np.ndarray, target: np.ndarray, reset: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Backpropagation through one window (step, stream), from the state that the window before left."""
        p, n = self.p, HIDDEN
        steps, streams = ids.shape
        x = p["embed"][ids]
        gates = _blocks(x @ p["input"] + p["bias"])
        kept, states, state = [], np.empty((steps, streams, n), np.float32), _blocks(p["state"])
        for t in range(steps):
            before = h * ~reset[t][:, None]
            h = states[t]
            kept.append((before, *self.advance(gates[:, t], before, h, state)))
        _, d_out, grads = self.losses(states.reshape(-1, n), target.reshape(-1), True)
        d_out = d_out.reshape(steps, streams, n)
        d_gates = np.empty((steps, streams, 3 * n), gates.dtype)
        d_state = np.zeros_like(p["state"])
        d_h = np.zeros((streams, n), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, new, inner = kept[t]
            d_h = d_h + d_out[t]
            d_new = d_h * (1 - z) * (1 - new * new)
            d_gates[t, :, :n] = d_h * (before - new) * z * (1 - z)
            d_gates[t, :, n : 2 * n] = d_new * inner * r * (1 - r)
            d_gates[t, :, 2 * n :] = d_new
            d_own = d_gates[t].copy()
            d_own[:, 2 * n :] *= r
            d_state += before.T @ d_own
            d_h = (d_h * z + d_own @ p["state"].T) * ~reset[t][:, None]
        flat = d_gates.reshape(-1, 3 * n)
        d_x = flat @ p["input"].T
        order = np.argsort(ids.reshape(-1).astype(np.uint16), kind="stable")
        sorted_ids = ids.reshape(-1)[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1])))
        grads["embed"] = np.zeros_like(p["embed"])
        grads["embed"][sorted_ids[first]] = np.add.reduceat(d_x[order], first, axis=0)
        grads |= {"input": x.reshape(-1, n).T @ flat, "bias": flat.sum(axis=0), "state": d_state}
        return grads, h

    def score(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 P of each whole text."""
        return np.bincount(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), weights=self.token_logs(ids, starts), minlength=len(starts) - 1)

    def token_logs(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 P of each token: a text's state starts at zero and is carried from window to window to its end."""
        lengths = np.diff(starts)
        begin = starts[:-1][np.argsort(-lengths, kind="stable")]
        longest = int(lengths.max(initial=0))
        #: How many texts have a token at each step.
        live = len(lengths) - np.cumsum(np.bincount(lengths, minlength=1))[:longest]
        inputs, state = _blocks(self.p["embed"] @ self.p["input"] + self.p["bias"]), _blocks(self.p["state"])
        out, end = np.zeros(len(ids)), ids[starts[1] - 1] if len(ids) else 0
        h = np.zeros((len(lengths), HIDDEN), inputs.dtype)
        total, first = np.cumsum(live), 0
        while first < longest:
            stop = int(np.searchsorted(total, FLUSH_ROWS + (total[first - 1] if first else 0))) + 1
            widths = live[first:stop]
            edges = np.concatenate(([0], np.cumsum(widths)))
            places = begin[np.arange(edges[-1]) - np.repeat(edges[:-1], widths)] + np.repeat(np.arange(first, first + len(widths)), widths)
            before = ids[places - 1]
            if first == 0:
                before[: widths[0]] = end
            gates = inputs.take(before, axis=1)
            states = np.empty((len(places), HIDDEN), inputs.dtype)
            for a, b in itertools.pairwise(edges.tolist()):
                self.advance(gates[:, a:b], h[: b - a], states[a:b], state)
                h = states[a:b]
            out[places] = self.losses(states, ids[places], False)[0]
            first = stop
        return out / LOG10


class Learner:
    """Steps with momentum and scaling (Adam) over blocks of tokens."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.count = network, rate, 0
        self.mean = {k: np.zeros_like(x) for k, x in network.p.items()}
        self.square = {k: np.zeros_like(x) for k, x in network.p.items()}

    def learn(self, ids: np.ndarray, starts: np.ndarray, end: int) -> None:
        """One pass over a block: cut into streams, read in windows; states are reset where documents begin.

        The streams are equal but for the last tokens, which one more token each of the first streams takes: those
        streams make a last step of their own.
        """
        streams = int(max(1, min(STREAMS, len(ids) // (4 * WINDOW))))
        long, more = divmod(len(ids), streams)
        before = np.concatenate(([end], ids[:-1]))
        reset = np.zeros(len(ids), bool)
        reset[starts[:-1]] = True
        before[starts[:-1]] = end
        begin = np.arange(streams) * long + np.minimum(np.arange(streams), more)
        at = begin + np.arange(long)[:, None]
        h = np.zeros((streams, HIDDEN), np.float32)
        for t in range(0, long, WINDOW):
            window = at[t : t + WINDOW]
            grads, h = self.network.gradients(before[window], ids[window], reset[window], h)
            self._update(grads, window.size)
        if more:
            window = begin[None, :more] + long
            grads, _ = self.network.gradients(before[window], ids[window], reset[window], h[:more])
            self._update(grads, window.size)

    def _update(self, grads: dict, n: int) -> None:
        self.count += 1
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values())) / n
        shrink = min(1.0, 1.0 / max(norm, 1e-12)) / n
        rate = self.rate * np.sqrt(1 - 0.99**self.count) / (1 - 0.9**self.count)
        for k, g in grads.items():
            g = g * np.float32(shrink)
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.01 * (g * g - self.square[k])
            self.network.p[k] -= (rate * self.mean[k] / (np.sqrt(self.square[k]) + 1e-8)).astype(np.float32)


# --- on Spark -------------------------------------------------------------------------------------


def _training_ids(docs: DataFrame, lexicon: Lexicon, text: str) -> DataFrame:
    """All training documents as codes of their tokens, dealt to rounds by content."""
    edges = np.cumsum(ROUNDS)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(0)):
                part = batch.slice(a, b - a)
                ids, starts, _, _ = token_codes(part.column(0), lexicon)
                own = [ids[i:j].astype("<u2").tobytes() for i, j in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), part.column(1)], names=["ids", "round"])

    deal = F.pmod(F.xxhash64(text), F.lit(int(edges[-1])))
    round_ = F.lit(len(ROUNDS) - 1)
    for i in range(len(ROUNDS) - 2, -1, -1):
        round_ = F.when(deal < int(edges[i]), i).otherwise(round_)
    return docs.select(text, round_.cast("int").alias("round")).mapInArrow(encoded, "ids binary, round int")


def _averaged(models: DataFrame) -> DataFrame:
    """Sum of weighted models over at most ``AVERAGING_TASKS`` groups, each summed as a stream; few models share a few tasks."""

    def summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0
        for batch in batches:
            for data, n in zip(batch.column("model"), batch.column("tokens").to_pylist()):
                part = np.frombuffer(data.as_py(), np.float32).astype(np.float64) * n
                total = part if total is None else total + part
                weight += n
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()]), pa.array([weight])], names=["group", "model", "tokens"])

    group = F.pmod(F.hash("task"), F.lit(AVERAGING_TASKS)).alias("group")
    return models.select(group, "model", "tokens").groupBy("group").applyInArrow(summed, "group int, model binary, tokens long")


def train(encoded: DataFrame, lexicon: Lexicon) -> bytes:
    """Train on all documents (a written ``_training_ids``) once, in rounds: tasks start from one model, learn from their part and are averaged.

    Averages weigh models by tokens and pass through at most ``AVERAGING_TASKS`` rows. A lost task is trained again.
    """
    network = Network(lexicon)
    for number, rate in enumerate(RATES):
        start = network.pack()

        def learned(batches: Iterator[pa.RecordBatch], start=start, rate=rate) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own = Network(lexicon)
            own.unpack(start)
            learner, seen, block, size = Learner(own, rate), 0, [], 0

            def learn():
                lengths = [len(x) for x in block]
                learner.learn(lexicon.network_ids[np.concatenate(block)], np.concatenate(([0], np.cumsum(lengths))), lexicon.end)

            for batch in batches:
                for data in batch.column(0):
                    block.append(np.frombuffer(data.as_py(), "<u2"))
                    size += len(block[-1])
                    if size >= BLOCK_TOKENS:
                        learn()
                        block, seen, size = [], seen + size, 0
            if block:
                learn()
                seen += size
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([own.pack()]), pa.array([seen])], names=["task", "model", "tokens"])

        part = encoded.where(F.col("round") == number).select("ids")
        models = written(part.mapInArrow(learned, "task long, model binary, tokens long"), "language-models")
        averages = sorted(_averaged(models).collect(), key=lambda r: r["group"])
        if averages:
            weights = np.array([r["tokens"] for r in averages], np.float64)
            stacked = np.stack([np.frombuffer(r["model"], np.float32) for r in averages])
            network.unpack(np.average(stacked, axis=0, weights=weights).astype(np.float32).tobytes())
    return network.pack()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to a bound of rows and bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SCORE_DOCUMENTS or sum(b.nbytes for b in held) >= SCORE_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def score_documents(docs: DataFrame, counts: DataFrame, lexicon: Lexicon, pairs: PairTable, model: bytes, text: str, keep: list[str]) -> DataFrame:
    """``keep, n_tokens, n_known, base_score, score``.

    One pass scores whole documents and lists each document's words outside the frequent ones; the counts of these
    are joined by word, which no document or word makes hot, and summed per document.
    """
    kept = [(f"__keep{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    out = StructType().add("row", "long")
    for name, kind in kept:
        out = out.add(name, kind)
    for name, kind in (("n_tokens", "long"), ("n_head", "long"), ("base", "double"), ("model", "double"), ("word", "string"), ("times", "long")):
        out = out.add(name, kind)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        network = Network(lexicon)
        network.unpack(model)
        row, base_log, size = TaskContext.get().partitionId() << 40, lexicon.base_log, len(lexicon.number)
        counted = np.fromiter(lexicon.head.values(), np.int64, len(lexicon.head))
        count_logs = np.log10(counted + 0.5)
        for batch in _gathered(batches):
            for a, b in byte_slices(batch.column(0), SCORE_BYTES):
                part = batch.slice(a, b - a)
                codes, starts, numbers, names = token_codes(part.column(0), lexicon)
                n, ids = len(part), lexicon.network_ids[codes]
                head, of = codes < len(counted), np.repeat(np.arange(n), np.diff(starts))
                logs = np.where(head, count_logs[np.minimum(codes, len(counted) - 1)], 0)
                # Words that the network doesn't tell apart have their share of their class; counts that aren't here are joined.
                value = network.token_logs(ids, starts)
                rare = ids >= size
                value[rare] += logs[rare] - lexicon.rare_log[ids[rare] - size]
                share, left = pairs.look_up(codes, lexicon.place[END])
                value += np.log10(left)
                paired = share > 0
                value[paired] = np.log10(share[paired] + 10 ** value[paired])
                value = np.bincount(of, weights=value, minlength=n)
                base = np.bincount(of, weights=logs - base_log, minlength=n)
                heads = np.bincount(of[head], weights=counted[codes[head]] > 0, minlength=n)
                rows = row + np.arange(n)
                columns = [pa.array(rows), *part.columns[1:], pa.array(np.diff(starts)), pa.array(heads), pa.array(base), pa.array(value), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if i > len(kept) else c for i, (c, f) in enumerate(zip(columns, _arrow(out)))], names=out.names)
                inside = np.ones(len(codes), bool)
                inside[starts[1:] - 1] = False
                outside, owner = numbers[~head[inside]], of[inside][~head[inside]]
                listed, times = np.unique(owner * max(1, len(names)) + outside, return_counts=True)
                if len(listed):
                    m = len(listed)
                    words = names.take(pa.array(listed % len(names)))
                    nothing = [pa.nulls(m, c.type) for c in part.columns[1:]]
                    columns = [pa.array(rows[listed // len(names)]), *nothing, *[pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], words, pa.array(times)]
                    whole = pa.RecordBatch.from_arrays(columns, names=out.names)
                    yield from (whole.slice(i, WORD_ROWS) for i in range(0, m, WORD_ROWS))
                row += n

    chosen = docs.select(F.col(text).alias("__text"), *[F.col(c).alias(name) for c, (name, _) in zip(keep, kept)])
    both = written(chosen.mapInArrow(scored, out), "language-scores")
    held = lexicon.distinct <= JOINED_WORDS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rare = both.where("word IS NOT NULL").select("row", "word", "times").join(counts.hint("shuffle_hash" if held else "merge"), "word", "left")
    seen = F.coalesce("n", F.lit(0))
    sums = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(seen + 0.5)).alias("logs"),
        F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("known"),
    )
    documents = both.where("word IS NULL").join(sums.hint("merge"), "row", "left")
    documents = documents.withColumn("logs", F.coalesce("logs", F.lit(0.0)))
    return documents.select(
        *[F.col(name).alias(c) for c, (name, _) in zip(keep, kept)],
        "n_tokens",
        (F.col("n_head") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + F.col("logs")).alias("base_score"),
        (F.col("model") + F.col("logs")).alias("score"),
    )


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def language_scores(docs: DataFrame, is_training: Column, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Count and train on the documents ``is_training``, then score every whole document.

    The network's probabilities are interpolated with the most frequent pairs of neighbouring words (``PairTable``), which it
    can't hold in its few units.

    Returns ``keep`` and ``n_tokens`` (words and one end), ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (sum of log10 of smoothed unigram shares) and ``score`` (log10 probability by the network). A rare word's
    probability is that of its class times its smoothed share of the class; each class keeps a share for unseen words. A null or empty
    text is its end alone. Equal rows get equal scores. An empty table gives an empty table.
    """
    prepare_session(docs.sparkSession)
    keep = keep or ["doc_id"]
    training = docs.where(is_training)
    counts = written(count_words(training, text), "language-counts")
    lexicon = read_lexicon(counts)
    encoded = written(_training_ids(training, lexicon, text), "language-ids")
    pairs = read_pairs(written(count_pairs(encoded, lexicon), "language-pairs"), lexicon)
    model = train(encoded, lexicon)
    scored = score_documents(docs, counts, lexicon, pairs, model, text, keep)
    return scored.withColumn("train_tokens", F.lit(lexicon.total).cast("long"))
