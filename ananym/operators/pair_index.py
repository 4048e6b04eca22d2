"""The words that vocabulary training still works on, in blocks that know which words hold a pair.

A block keeps its words' symbols one after another, and an index: all neighbouring pairs in ascending order, each with its word. A
round looks up the pairs it needs and touches only the words they stand in; the index entries of those words are replaced and
what that changes in the counts of pairs is handed on, so that pairs are counted once and then only corrected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananym.session import FAT_ROWS, scratch_path

# Token id i is written as this code point + i while training; ids stay below 2**20.
SYMBOL_BASE = 0x10000
ID_BITS = 20
BLOCK_SYMBOLS = 1 << 16
LONG_WORD = 64
# Steps of the logarithm by which pairs are counted by frequency.
FREQUENCY_STEPS = 64
NEVER = np.iinfo(np.int64).max

_ARRAYS = {"symbols": np.int32, "starts": np.int64, "counts": np.int64, "keys": np.int64, "owners": np.int32}
BLOCKS = ", ".join(f"{name} binary" for name in _ARRAYS) + ", pairs array<bigint>, changes array<bigint>, touched bigint"
RUNS = "run string, n bigint"


def symbol(token_id: int) -> str:
    return chr(SYMBOL_BASE + token_id)


def key_of(pair: str) -> int:
    """A pair as a number; numbers are ordered as the pairs are."""
    return (ord(pair[0]) - SYMBOL_BASE) << ID_BITS | (ord(pair[1]) - SYMBOL_BASE)


def pair_of(key: int) -> str:
    return symbol(key >> ID_BITS) + symbol(key & ((1 << ID_BITS) - 1))


# --- runs of numbers ------------------------------------------------------------------------------


def taken(begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of several ranges one after another, and where each range starts among them (one more at the end)."""
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return np.repeat(begin - starts[:-1], lengths) + np.arange(starts[-1]), starts


def _neighbours(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each symbol and the next, and whether both stand in one word; the last symbol has no next."""
    keys = symbols[:-1].astype(np.int64) << ID_BITS | symbols[1:]
    inside = np.ones(len(keys), bool)
    inside[starts[1:-1] - 1] = False
    return keys, inside


def _found(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in the ascending ``among``, and whether it does."""
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return at, among[at] == keys


class Merges:
    """Merges of one round, in their order."""

    def __init__(self, keys: np.ndarray, made: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made.astype(np.int32)
        self.rank = dict(zip(keys.tolist(), range(len(keys))))

    @staticmethod
    def of(merges: list[tuple[str, str]]) -> Merges:
        return Merges(np.array([key_of(pair) for pair, _ in merges], np.int64), np.array([ord(new) - SYMBOL_BASE for _, new in merges]))

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        at, known = _found(keys, self.keys)
        return np.where(known, self.ranks[at], NEVER)

    def stepping_back(self) -> np.ndarray:
        """For each merge, whether what it makes takes part in an earlier one, so that a word may go back to that."""
        sides = np.concatenate((self.keys >> ID_BITS, self.keys & ((1 << ID_BITS) - 1)))
        first = np.full(1 << ID_BITS, NEVER)
        np.minimum.at(first, sides, np.concatenate((self.ranks, self.ranks)))
        return first[self.made] < np.arange(len(self.made))

    def applied(self, symbols: np.ndarray, starts: np.ndarray, watched: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words after all merges, one merge after the other, each from left to right without overlaps.

        Also returns the words that one of the ``watched`` merges, given by a flag for each, was made in, and all long ones.
        """
        lengths = np.diff(starts)
        words, parts = np.flatnonzero(lengths <= LONG_WORD), []
        long = [(w, self._long(symbols[starts[w] : starts[w + 1]])) for w in np.flatnonzero(lengths > LONG_WORD).tolist()]
        noted = [np.flatnonzero(lengths > LONG_WORD)]
        places, own_starts = taken(starts[words], lengths[words])
        here, done = symbols[places], np.full(len(words), -1)
        owner = np.repeat(np.arange(len(words)), lengths[words])
        rank = np.full(len(here), NEVER)
        if len(words):
            keys, inside = _neighbours(here, own_starts)
            rank[:-1] = np.where(inside, self._ranks(keys), NEVER)
        while len(words):
            least = np.minimum.reduceat(rank, own_starts[:-1])
            going = least < NEVER
            if not going.all():
                settled = ~going[owner]
                parts.append((words[~going], here[settled], np.diff(own_starts)[~going]))
                here, rank, owner = here[~settled], rank[~settled], (np.cumsum(going) - 1)[owner[~settled]]
                words, least = words[going], least[going]
                if not len(words):
                    break
            if watched is not None:
                noted.append(words[watched[least]])
            chosen = rank == least[owner]
            # In a row of equal symbols every second pair is merged.
            place = np.arange(len(here))
            first = chosen.copy()
            first[1:] &= ~(chosen[:-1] & (owner[1:] == owner[:-1]))
            chosen &= (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
            merged = np.flatnonzero(chosen)
            here[merged] = self.made[rank[merged]]
            left = np.ones(len(here), bool)
            left[merged + 1] = False
            here, owner, rank, done = here[left], owner[left], rank[left], least
            # Only pairs beside a merged symbol have changed; an earlier merge does not come again.
            merged -= np.arange(len(merged))
            rank[merged] = NEVER
            before = np.concatenate((merged, merged[merged > 0] - 1))
            before = before[before + 1 < len(owner)]
            before = before[owner[before] == owner[before + 1]]
            new = self._ranks(here[before].astype(np.int64) << ID_BITS | here[before + 1])
            rank[before] = np.where(new > done[owner[before]], new, NEVER)
            own_starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))
        order = np.concatenate([w for w, _, _ in parts] + [np.array([w for w, _ in long], np.int64)])
        sizes = np.concatenate([n for _, _, n in parts] + [np.array([len(s) for _, s in long], np.int64)])
        flat = np.concatenate([s for _, s, _ in parts] + [s for _, s in long] + [np.zeros(0, np.int32)])
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        back = np.argsort(order)
        places, after = taken(begin[back], sizes[back])
        return flat[places], after, np.unique(np.concatenate(noted))

    def _long(self, symbols: np.ndarray) -> np.ndarray:
        """The same for a long word: only the neighbours of what is merged are looked at again."""
        own: list[int | None] = symbols.tolist()
        end = len(own)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = [(self.rank[k], i) for i, k in enumerate((a << ID_BITS | b) for a, b in zip(own, own[1:])) if k in self.rank]
        heapify(queue)
        while queue:
            done, i = heappop(queue)
            j = after[i]
            if own[i] is None or j == end or self.rank.get(own[i] << ID_BITS | own[j]) != done:
                continue
            own[i], own[j] = int(self.made[done]), None
            k = after[i] = after[j]
            if k < end:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < end and self.rank.get(own[x] << ID_BITS | own[y], -1) > done:
                    heappush(queue, (self.rank[own[x] << ID_BITS | own[y]], x))
        return np.array([s for s in own if s is not None], np.int32)


@dataclass
class Block:
    """Words: ``symbols`` from ``starts``, their ``counts``; index: pairs as ascending ``keys`` with the words that own them."""

    symbols: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    keys: np.ndarray
    owners: np.ndarray

    @staticmethod
    def of(words: list[str], counts: list[int]) -> Block:
        symbols = (np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) - SYMBOL_BASE).astype(np.int32)
        starts = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
        block = Block(symbols, starts, np.array(counts, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        block.keys, block.owners = block._index(np.arange(len(words)))
        return block

    def _index(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index entries of some words, in order."""
        lengths = np.diff(self.starts)[words]
        places, starts = taken(self.starts[words], lengths)
        keys, inside = _neighbours(self.symbols[places], starts)
        owners = np.repeat(words, lengths)[:-1][inside].astype(np.int32)
        order = np.argsort(keys[inside], kind="stable")
        return keys[inside][order], owners[order]

    def holding(self, keys: np.ndarray) -> np.ndarray:
        """The words that hold any of the pairs."""
        begin, end = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        places, _ = taken(begin, end - begin)
        return np.unique(self.owners[places])

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of the block and how often they occur."""
        return _summed(self.keys, self.counts[self.owners])

    def merge(self, merges: Merges) -> tuple[Block, np.ndarray, np.ndarray, int]:
        """The block after some merges, the pairs whose counts that changes, by how much, and how many words were touched."""
        touched = self.holding(merges.keys)
        if not len(touched):
            return self, np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        lengths = np.diff(self.starts)
        places, starts = taken(self.starts[touched], lengths[touched])
        symbols, starts, _ = merges.applied(self.symbols[places], starts)
        # Words stand where they stood; those of a single symbol leave.
        begin, size = self.starts[:-1].copy(), lengths.copy()
        begin[touched], size[touched] = len(self.symbols) + starts[:-1], np.diff(starts)
        stays = size > 1
        places, after = taken(begin[stays], size[stays])
        number = np.cumsum(stays) - 1
        hit = np.zeros(len(stays), bool)
        hit[touched] = True
        gone = hit[self.owners]
        block = Block(np.concatenate((self.symbols, symbols))[places], after, self.counts[stays], self.keys, self.owners)
        new_keys, new_owners = block._index(number[touched[stays[touched]]])
        keys = np.concatenate((self.keys[gone], new_keys))
        by = np.concatenate((-self.counts[self.owners[gone]], block.counts[new_owners]))
        kept_keys, kept_owners = self.keys[~gone], number[self.owners[~gone]].astype(np.int32)
        at = np.searchsorted(kept_keys, new_keys)
        block.keys, block.owners = np.insert(kept_keys, at, new_keys), np.insert(kept_owners, at, new_owners)
        pairs, changes = _summed(keys, by)
        return block, pairs[changes != 0], changes[changes != 0], len(touched)

    def runs(self, keys: np.ndarray) -> Counter[str]:
        """The longest stretches of words in which all neighbouring pairs are among ``keys``, with their counts."""
        words = self.holding(keys)
        places, starts = taken(self.starts[words], np.diff(self.starts)[words])
        symbols = self.symbols[places]
        own, inside = _neighbours(symbols, starts)
        wanted = np.zeros(len(own) + 2, bool)
        wanted[1:-1] = _found(own, keys)[1] & inside
        begin, end = np.flatnonzero(wanted[1:] & ~wanted[:-1]), np.flatnonzero(wanted[:-1] & ~wanted[1:])
        text = (symbols + SYMBOL_BASE).astype("<u4").tobytes().decode("utf-32-le")
        counts = self.counts[words[np.searchsorted(starts, begin, "right") - 1]]
        found: Counter[str] = Counter()
        for a, b, n in zip(begin.tolist(), end.tolist(), counts.tolist()):
            found[text[a : b + 1]] += n
        return found


def _summed(keys: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, by
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(by[order], first)


# --- over Spark -----------------------------------------------------------------------------------


def _row(block: Block, pairs: np.ndarray, changes: np.ndarray, touched: int) -> pa.RecordBatch:
    columns = {name: pa.array([getattr(block, name).astype(kind).tobytes()], pa.binary()) for name, kind in _ARRAYS.items()}
    columns |= {name: pa.array([values], pa.list_(pa.int64())) for name, values in (("pairs", pairs), ("changes", changes))}
    return pa.RecordBatch.from_pydict(columns | {"touched": pa.array([touched], pa.int64())})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(*(np.frombuffer(batch.column(name)[i].as_buffer(), kind) for name, kind in _ARRAYS.items()))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of about ``BLOCK_SYMBOLS``; a longer word is in a block with few others."""
    words: list[str] = []
    counts: list[int] = []
    size = 0
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            words.append(word)
            counts.append(n)
            size += len(word)
            if size >= BLOCK_SYMBOLS:
                block = Block.of(words, counts)
                yield _row(block, *block.summed(), len(words))
                words, counts, size = [], [], 0
    if words:
        block = Block.of(words, counts)
        yield _row(block, *block.summed(), len(words))


class PairIndex:
    """Blocks and the counts of all pairs as tables in the shared folder, each in two places by turns.

    So the plan does not grow with the rounds and a lost executor re-reads what the last round has written.
    """

    def __init__(self, words: DataFrame):
        """``words(word, n)`` spelled in symbols."""
        self.spark = words.sparkSession
        self.path = scratch_path(self.spark, "pair-index")
        self.rounds = 0
        several = words.select("word", "n").where(F.length("word") > 1)
        self.blocks = self._written(several.mapInArrow(_packed, BLOCKS), "blocks", BLOCKS)
        self.counts = self._written(self._changes().groupBy("pair").agg(F.sum("n").alias("n")), "counts", "pair bigint, n bigint")

    def _written(self, table: DataFrame, name: str, schema: str) -> DataFrame:
        target = f"{self.path}/{name}-{self.rounds % 2}"
        table.write.mode("overwrite").options(**FAT_ROWS).parquet(target)
        return self.spark.read.schema(schema).parquet(target)

    def _changes(self) -> DataFrame:
        return self.blocks.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("changes").alias("n"))))

    def top(self, most: int, least: int) -> list[tuple[str, int]]:
        """The most frequent pairs, equal counts by smaller ids.

        Counts of pairs by frequency tell how far down to go, so that tasks sort little else than what is taken; ``collect`` would
        then send each task's own ``most`` pairs to the driver, ``toArrow`` sends those of all.
        """
        step = F.floor(F.log2("n") * FREQUENCY_STEPS).cast("int")
        frequent = self.counts.where(F.col("n") >= least)
        taken, lowest = 0, 0
        for row in sorted(frequent.groupBy(step.alias("step")).count().collect(), reverse=True):
            taken, lowest = taken + row["count"], row["step"]
            if taken >= most:
                break
        rows = frequent.where(step >= lowest).orderBy(F.desc("n"), "pair").limit(most).toArrow()
        return [(pair_of(key), n) for key, n in zip(rows["pair"].to_pylist(), rows["n"].to_pylist())]

    def runs(self, pairs: list[str]) -> DataFrame:
        """(run, n): the longest stretches of words in which all neighbouring pairs are among ``pairs``."""
        keys = np.array(sorted(map(key_of, pairs)), np.int64)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                found = block.runs(keys)
                yield pa.RecordBatch.from_pydict({"run": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

        arrays = self.blocks.select(*_ARRAYS)
        return arrays.mapInArrow(cut, RUNS).groupBy("run").agg(F.sum("n").alias("n"))

    def merge(self, merges: list[tuple[str, str]]) -> None:
        """Apply merges to the words that hold them, and correct the counts of pairs by what that changed."""
        ordered = Merges.of(merges)

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                yield _row(*block.merge(ordered))

        self.rounds += 1
        self.blocks = self._written(self.blocks.select(*_ARRAYS).mapInArrow(rewrite, BLOCKS), "blocks", BLOCKS)
        both = self.counts.unionByName(self._changes()).groupBy("pair").agg(F.sum("n").alias("n")).where("n != 0")
        self.counts = self._written(both, "counts", "pair bigint, n bigint")
