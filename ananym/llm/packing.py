"""Packing documents into sequences of several lengths."""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ananym.llm.common import byte_slices, prepare_session, text_buffer, tiles

TIERS = (128, 256, 512, 1024)
END_ID = 0
BLOCK_DOCUMENTS = 4000
BLOCK_TOKENS = 4 << 20
STEP_TOKENS = 16_384
CACHED_PIECES = 300_000

# Byte-level vocabularies write bytes that are no visible Latin-1 character as the characters from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


# --- token ids ------------------------------------------------------------------------------------


class Encoder:
    """Token ids of whole batches of texts, by a byte-level BPE file of the ``tokenizers`` library.

    Texts are cut into the vocabulary's pre-tokens (pieces) for a whole batch at once; the library's model merges each distinct
    piece once, and pieces met before come from a bounded cache. A text with a special token in it is
    encoded by the library as a whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters, numbers, spaces = (regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"\s+"))
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        self.kinds = np.full(0x110000, _OTHER, np.uint8)
        for pattern, kind in ((letters, _LETTER), (numbers, _NUMBER), (spaces, _SPACE)):
            for m in pattern.finditer(every):
                begin, end = m.span()
                shift = lambda i: i if i < 0xD800 else i + 0x800
                self.kinds[shift(begin) : shift(end - 1) + 1] = kind
        self._forget()

    def _piece_starts(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """True where a piece begins; ``starts`` are the first characters of texts."""
        n = len(points)
        kind = self.kinds[points]
        head = np.zeros(n + 1, bool)
        head[starts] = True
        head[n] = True
        run = head[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        begin = run.copy()
        # The last white space before other text stands alone, or goes with what follows if it is a plain blank.
        followed = np.zeros(n, bool)
        followed[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~head[1:n]
        begin |= followed
        blank = np.flatnonzero(followed & (points == 32))
        begin[blank + 1] = False
        # Contractions: an apostrophe alone between pieces takes a few letters with it.
        quote = np.flatnonzero((points == 39) & begin)
        quote = quote[(quote + 1 < n)]
        quote = quote[run[quote + 1] & (kind[quote + 1] == _LETTER) & ~head[quote + 1]]
        for q in quote:
            last = q + 2
            while last < min(n, q + 3) and not head[last] and kind[last] == _LETTER:
                last += 1
            tail = "".join(map(chr, points[q + 1 : last]))
            take = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail in ("re", "ve", "ll") else 0
            if take:
                begin[q + 1] = False
                if q + 1 + take < n:
                    begin[q + 1 + take] = True
        return begin

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, each with the end id, and where each text's ids start (one more at the end)."""
        raw, starts = text_buffer(texts)
        raw = np.ascontiguousarray(raw)
        whole = self._special_texts(raw, starts)
        lengths = np.ones(len(starts) - 1, np.int64)
        if len(raw):
            char = np.flatnonzero((raw & 0xC0) != 0x80)
            points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
            first = starts[:-1][starts[:-1] < starts[1:]]
            begin = self._piece_starts(points, np.searchsorted(char, first))
            edges = np.append(char[np.flatnonzero(begin)], len(raw))
            coded = tiles(raw, edges).dictionary_encode()
            codes = np.asarray(coded.indices)
            flat, at, size = self._pieces(coded.dictionary.to_pylist())
            bounds = np.searchsorted(edges[:-1], starts)
            counts = size[codes]
            ends = np.concatenate(([0], np.cumsum(counts)))
            lengths += ends[bounds[1:]] - ends[bounds[:-1]]
            position = np.arange(ends[-1]) - np.repeat(ends[:-1] - at[codes], counts)
            body = flat[position]
        else:
            body = np.zeros(0, np.uint32)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        ids = np.full(offsets[-1], END_ID, np.uint32)
        inside = np.ones(offsets[-1], bool)
        inside[offsets[1:] - 1] = False
        ids[inside] = body
        return self._with_whole(ids, offsets, texts, whole) if whole else (ids, offsets)

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces: the ids of all known pieces in one array, and each one's place in it and number."""
        if len(self.place) > CACHED_PIECES:
            self._forget()
        place, flat, ends = self.place, self.flat, self.ends
        at = np.empty(len(pieces), np.int64)
        for i, piece in enumerate(pieces):
            found = place.get(piece)
            if found is None:
                found = place[piece] = len(ends) - 1
                flat.extend([t.id for t in self.tokenizer.model.tokenize(piece.decode("latin-1").translate(_BYTE_SIGNS))])
                ends.append(len(flat))
            at[i] = found
        edges = np.array(ends, np.int64)
        return np.array(flat, np.uint32), edges[at], edges[at + 1] - edges[at]

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def _special_texts(self, raw: np.ndarray, starts: np.ndarray) -> list[int]:
        data = raw.tobytes()
        rows = set()
        for token in self.special:
            at = data.find(token)
            while at >= 0:
                rows.add(int(np.searchsorted(starts, at, side="right")) - 1)
                at = data.find(token, at + 1)
        return sorted(rows)

    def _with_whole(self, ids: np.ndarray, offsets: np.ndarray, texts: pa.Array, rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
        parts = [ids[a:b] for a, b in zip(offsets, offsets[1:])]
        for i in rows:
            own = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids
            parts[i] = np.array([*own, END_ID], np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


# --- packing a block ------------------------------------------------------------------------------


def pack_block(counts: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces for documents of ``counts`` tokens.

    Full windows of the longest tier are cut off; the rest of each document goes to the shortest tier that holds it.
    From long to short, each rest opens a window of its tier, whose gap takes the longest shorter rests that fit and
    at last a piece cut off the next one. Windows that nothing is left to fill are joined and cut anew at the longest
    tier; only the last sequence of a block can be short.
    """
    longest = tiers[-1]
    sequences, rests = [], []
    for doc, n in enumerate(counts):
        full = n // longest
        sequences += [[(doc, i * longest, longest)] for i in range(full)]
        if n % longest:
            rests.append((n % longest, doc, full * longest))
    rests.sort()
    sizes = [r[0] for r in rests]
    open_pieces: list[tuple[int, int, int]] = []
    while rests:
        size, doc, start = rests.pop()
        sizes.pop()
        tier = next(t for t in tiers if size <= t)
        window, gap = [(doc, start, size)], tier - size
        while gap and rests:
            i = bisect_right(sizes, gap)
            if i:
                size, doc, start = rests.pop(i - 1)
                sizes.pop(i - 1)
                window.append((doc, start, size))
                gap -= size
            elif sizes[0] <= tier // 2:
                size, doc, start = rests.pop(0)
                sizes.pop(0)
                window.append((doc, start, gap))
                rest = (size - gap, doc, start + gap)
                gap = 0
                i = bisect_right(sizes, rest[0])
                rests.insert(i, rest)
                sizes.insert(i, rest[0])
            else:
                break
        if gap:
            open_pieces += window
        else:
            sequences.append(window)
    window, gap = [], longest
    for doc, start, size in open_pieces:
        while size:
            part = min(size, gap)
            window.append((doc, start, part))
            start, size, gap = start + part, size - part, gap - part
            if not gap:
                sequences.append(window)
                window, gap = [], longest
    if window:
        sequences.append(window)
    return sequences


def balance_steps(lengths: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step for each sequence: longest first, each to the step with the fewest tokens."""
    steps = [(0, i) for i in range(max(1, -(-sum(lengths) // step_tokens)))]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        load, step = heapq.heappop(steps)
        out[i] = step
        heapq.heappush(steps, (load + lengths[i], step))
    return out


def padded_length(length: int, longest: int = TIERS[-1]) -> int:
    return length if length & (length - 1) == 0 else longest


# --- on Spark -------------------------------------------------------------------------------------


def pack(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    tiers: tuple[int, ...] = TIERS,
    as_array: bool = False,
) -> DataFrame:
    """Pieces of all documents in packed sequences.

    Each task encodes its documents and packs them block by block (about 4,000 documents or 4 million tokens), so no token is shuffled
    and memory is bounded by a block or one document; padding is at most one short sequence per block. A block does not depend
    on others: a task that is run again gives the same pieces. Other input splits give other, equally valid sequences.

    Returns ``keep`` and per piece ``start, length, ids`` (little-endian 32-bit numbers, or ``array<int>`` with ``as_array``),
    ``doc_tokens, sequence_id, offset, sequence_length, padded_length, step``. Every document ends with the end id, so a null or
    empty text is one piece of that id. Equal rows are packed each for itself. An empty table gives an empty table.
    ``tokenizer`` is a file that every executor can read.
    """
    prepare_session(docs.sparkSession)
    ids_type = T.ArrayType(T.IntegerType()) if as_array else T.BinaryType()
    longs = ("start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length", "padded_length", "step")
    keep = tuple(keep)
    schema = T.StructType(
        [docs.schema[c] for c in keep] + [T.StructField("ids", ids_type)] + [T.StructField(c, T.LongType()) for c in longs]
    )

    def packed_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block, kept, tokens = None, [], [], 0
        prefix, made, steps = TaskContext.get().partitionId() << 36, 0, 0

        def flush():
            nonlocal made, steps
            documents = [ids[a:b] for ids, offsets in block for a, b in zip(offsets, offsets[1:])]
            sequences = pack_block([len(d) for d in documents], tiers)
            sizes = [sum(p[2] for p in s) for s in sequences]
            own_steps = balance_steps(sizes)
            columns: dict[str, list] = {c: [] for c in ("doc", "ids", *longs)}
            for number, (sequence, size, step) in enumerate(zip(sequences, sizes, own_steps)):
                offset = 0
                for doc, start, length in sequence:
                    piece = documents[doc][start : start + length]
                    row = (doc, piece if as_array else piece.astype("<u4").tobytes(), start, length, len(documents[doc]), prefix + made + number, offset, size, padded_length(size, tiers[-1]), prefix + steps + step)
                    for values, value in zip(columns.values(), row):
                        values.append(value)
                    offset += length
            made, steps = made + len(sequences), steps + max(own_steps) + 1
            rows = pa.Table.from_batches(kept).combine_chunks()
            out = [rows.column(i).take(pa.array(columns["doc"])) for i in range(len(keep))]
            out.append(pa.array(columns["ids"], pa.list_(pa.int32()) if as_array else pa.binary()))
            out += [pa.array(columns[c], pa.int64()) for c in longs]
            names = [f"c{i}" for i in range(len(keep))] + ["ids", *longs]
            yield from pa.table(dict(zip(names, out))).rename_columns([*keep, "ids", *longs]).to_batches(max_chunksize=2000)

        for batch in batches:
            encoder = encoder or Encoder(tokenizer)
            for a, b in byte_slices(batch.column(0)):
                part = batch.slice(a, b - a)
                ids, offsets = encoder.encode(part.column(0))
                block.append((ids, offsets))
                kept.append(pa.RecordBatch.from_arrays(part.columns[1:], names=[f"c{i}" for i in range(len(keep))]))
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS or sum(len(o) - 1 for _, o in block) >= BLOCK_DOCUMENTS:
                    yield from flush()
                    block, kept, tokens = [], [], 0
        if block:
            yield from flush()

    return docs.select(docs[text].alias("__text"), *keep).mapInArrow(packed_tasks, schema)
