"""Token ids of whole Arrow batches: distinct words are encoded together, and no list is built per row."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ananym.config import SPECIAL_TOKENS, UNK, WORD_MARK
from ananym.operators.pair_index import ID_BITS, Merges, taken

SLICE_BYTES = 2 << 20
LITERAL = re.compile("(" + "|".join(map(re.escape, SPECIAL_TOKENS)) + ")")


def slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Consecutive rows of about ``most`` bytes; a longer text stands alone."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def normalised(texts: pa.Array) -> pa.Array:
    """NFKC; texts of ASCII alone stay as they are."""
    plain = pc.string_is_ascii(texts)
    if pc.all(plain).as_py() in (True, None):
        return texts
    others = pc.invert(plain)
    changed = [unicodedata.normalize("NFKC", t) for t in texts.filter(others).to_pylist()]
    return pc.replace_with_mask(texts, others, pa.array(changed, pa.string()))


def split_words(texts: pa.Array, first_words: int | None = None, normalise: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts one after another, without their mark, and how many each text has; an empty text has none."""
    texts = pc.replace_substring(normalised(texts) if normalise else texts, WORD_MARK, " ")
    empty = np.asarray(pc.equal(texts, ""))
    texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
    parts = pc.split_pattern(texts, " ")
    counts = np.asarray(pc.list_value_length(parts), dtype=np.int64)
    words = parts.flatten()
    if empty.any():
        words = words.filter(pa.array(np.repeat(~empty, counts)))
        counts = np.where(empty, 0, counts)
    if first_words is not None:
        starts = np.cumsum(counts) - counts
        words = words.filter(pa.array(np.arange(len(words)) - np.repeat(starts, counts) < first_words))
        counts = np.minimum(counts, first_words)
    return words, counts


class Encoder:
    """A vocabulary as arrays, built once per task and bounded by the vocabulary's size.

    ``one_word`` encodes a single word by its merges in order. Distinct words are merged together, rank by rank, which gives the
    same unless a merge makes a token that takes part in an earlier merge: those words are encoded one by one.
    """

    def __init__(self, token_ids: dict[str, int], pairs: dict[tuple[int, int], tuple[int, int]], one_word: Callable[[str], list[int]]):
        self.token_ids, self.one_word = token_ids, one_word
        singles = {ord(t): i for t, i in token_ids.items() if len(t) == 1}
        self.by_code_point = np.full(0x110000, token_ids[UNK], np.int32)
        self.by_code_point[list(singles)] = list(singles.values())
        ordered = sorted((rank, left << ID_BITS | right, made) for (left, right), (rank, made) in pairs.items())
        self.merges = Merges(np.array([key for _, key, _ in ordered], np.int64), np.array([made for *_, made in ordered], np.int64))
        self.back = self.merges.stepping_back()

    def distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, given without their mark, one after another, and where each word's start."""
        text = WORD_MARK + WORD_MARK.join(words) if words else ""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = np.append(np.flatnonzero(points == ord(WORD_MARK)), len(points))
        if not len(words) or not len(self.merges.keys):
            return self.by_code_point[points], starts
        ids, after, noted = self.merges.applied(self.by_code_point[points], starts, self.back)
        # All long words are noted; they need it only where some merge steps back.
        again = noted if self.back.any() else noted[:0]
        if len(again):
            parts = np.split(ids, after[1:-1])
            for w in again.tolist():
                parts[w] = np.array(self.one_word(WORD_MARK + words[w]), np.int32)
            ids, after = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, after

    def placed(self, words: pa.Array, bounds: np.ndarray, special: tuple[np.ndarray, list[str]] | None = None) -> pa.Array:
        """One list of ids for each range of ``words``; ``special`` gives tokens to put in before given words."""
        coded = words.dictionary_encode()
        ids, starts = self.distinct(coded.dictionary.to_pylist())
        codes = np.asarray(coded.indices, dtype=np.int64)
        if special:
            before, tokens = special
            codes = np.insert(codes, before, [len(starts) - 1 + SPECIAL_TOKENS.index(t) for t in tokens])
            ids = np.concatenate((ids, [self.token_ids[t] for t in SPECIAL_TOKENS])).astype(np.int32)
            starts = np.concatenate((starts, starts[-1] + 1 + np.arange(len(SPECIAL_TOKENS))))
        lengths = np.diff(starts)
        places, ends = taken(starts[codes], lengths[codes])
        return pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(ids[places], pa.int32()))

    def parts(self, texts: pa.Array, first_words: int | None = None, match_special: bool = False) -> Iterator[pa.Array]:
        """A list of ids for each text, null having none, in parts as they are encoded: no more than one part's ids are held."""
        for part in slices(pc.fill_null(texts.cast(pa.string()), ""), SLICE_BYTES):
            yield self._slice(part, first_words, match_special)

    def texts(self, texts: pa.Array, first_words: int | None = None, match_special: bool = False) -> pa.Array:
        """The same as one array."""
        out = list(self.parts(texts, first_words, match_special))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    def _slice(self, texts: pa.Array, first_words: int | None, match_special: bool) -> pa.Array:
        if not match_special or not pc.any(pc.match_substring_regex(texts, LITERAL.pattern)).as_py():
            words, counts = split_words(texts, first_words)
            return self.placed(words, np.concatenate(([0], np.cumsum(counts))))
        # Texts are cut around literal special tokens: parts at even places are text, those between are tokens.
        parts = [LITERAL.split(t) for t in texts.to_pylist()]
        segments = [segment for row in parts for segment in row[::2]]
        words, counts = split_words(pa.array(segments, pa.string()))
        after = np.cumsum(counts)
        last = np.cumsum([len(row) // 2 + 1 for row in parts]) - 1
        inner = np.setdiff1d(np.arange(len(segments)), last)
        tokens = [token for row in parts for token in row[1::2]]
        placed = np.cumsum([len(row) // 2 for row in parts])
        return self.placed(words, np.concatenate(([0], after[last] + placed)), (after[inner], tokens))
