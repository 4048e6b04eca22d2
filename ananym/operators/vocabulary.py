"""Byte-pair vocabulary: training in Spark rounds, special tokens, report.

During training a word is a string with one private character per token, so that a merge is an ordinary
string replacement and a pair is two neighbouring characters.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ananym.config import BOS, EOS, PAD, UNK, VocabConfig
from ananym.operators.pair_index import ID_BITS, SYMBOL_BASE, PairIndex, symbol
from ananym.operators.words import character_counts, only, top_alphabet
from ananym.session import small_batches, spread, stored

MAX_VOCAB = 1 << ID_BITS
END_OF_SYMBOLS = chr(0x10FFFF)

# What the driver may hold in one round: pairs, distinct runs of them, and symbols in those runs.
MAX_PAIRS = 32_768
MAX_RUNS = 200_000
MAX_RUN_SYMBOLS = 1_000_000
FIRST_PAIRS = 64

VOCAB_SCHEMA = "id int, token string, is_special boolean"
MERGES_SCHEMA = "rank int, left string, right string"


@dataclass(frozen=True)
class Vocabulary:
    """``vocab(id, token, is_special)`` and ``merges(rank, left, right)``."""

    vocab: DataFrame
    merges: DataFrame

    def save(self, path: str, mode: str = "errorifexists") -> None:
        self.vocab.write.mode(mode).parquet(f"{path}/vocab")
        self.merges.write.mode(mode).parquet(f"{path}/merges")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Vocabulary:
        return Vocabulary(
            spark.read.schema(VOCAB_SCHEMA).parquet(f"{path}/vocab"),
            spark.read.schema(MERGES_SCHEMA).parquet(f"{path}/merges"),
        )


def _as_symbols(word: Column, alphabet: list[str]) -> Column:
    """Words as symbols; characters outside the alphabet are dropped."""
    symbols = "".join(symbol(i + 1) for i in range(len(alphabet)))
    return F.translate(only(word, alphabet), "".join(alphabet), symbols)


def bounded_runs(
    index: PairIndex, ranked: list[tuple[str, int]], last: tuple[int, str]
) -> tuple[list[tuple[str, int]], tuple[int, str]]:
    """Runs of the most frequent pairs with their counts, from as many pairs as keep the runs small.

    Returns the runs and the last place in the ranking ``(-count, pair)`` that is known from them; ``last`` is
    that place for the whole list. Few pairs make few and short runs however many words there are; when
    the runs are still over the limits, half the pairs are tried, and with none left the list is empty.
    """
    while ranked:
        runs = index.runs([pair for pair, _ in ranked]).persist()
        size = runs.agg(F.count("*").alias("runs"), F.sum(F.length("run")).alias("symbols")).first()
        small = size["runs"] <= MAX_RUNS and size["symbols"] <= MAX_RUN_SYMBOLS
        rows = [(r["run"], r["n"]) for r in runs.collect()] if small else []
        runs.unpersist()
        if small:
            return rows, last
        ranked = ranked[: len(ranked) // 2]
        last = (-ranked[-1][1], ranked[-1][0]) if ranked else last
    return [], last


class Tokens:
    """The growing vocabulary: spelling to id, and the merges so far."""

    def __init__(self, alphabet: list[str]):
        self.spellings = [UNK, *alphabet]
        self.ids = {t: i for i, t in enumerate(self.spellings)}
        self.merges: list[tuple[int, int]] = []

    def __len__(self) -> int:
        return len(self.spellings)

    def merge(self, pair: str) -> tuple[str, bool]:
        """Record a merge; returns the symbol for it and whether its spelling was there before."""
        left, right = (ord(s) - SYMBOL_BASE for s in pair)
        spelling = self.spellings[left] + self.spellings[right]
        seen = spelling in self.ids
        if not seen:
            self.ids[spelling] = len(self.spellings)
            self.spellings.append(spelling)
        self.merges.append((left, right))
        return symbol(self.ids[spelling]), seen


def certain_merges(
    runs: list[tuple[str, int]], last: tuple[int, str], tokens: Tokens, vocab_size: int
) -> list[tuple[str, str]]:
    """All merges that the runs decide, in ranking order: by count, equal counts by smaller ids.

    Each pair ranked up to ``last`` lies inside runs wherever it occurs. A pair that merging creates
    stands where an older pair stood, is never more frequent, and has a larger id: inside runs it is
    counted here, and elsewhere it ranks after ``last`` as the older pair did. So the ranking up to
    ``last`` is exact. A merge whose spelling exists already may add to pairs outside and ends the round.
    """
    # All runs one after another, an empty symbol after each; merged symbols are unlinked, so that a merge costs
    # its occurrences and not the runs that hold them.
    symbols: list[str | None] = []
    weight: list[int] = []
    for run, n in runs:
        symbols += [*run, ""]
        weight += [n] * (len(run) + 1)
    end = len(symbols)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    counts: Counter[str] = Counter()
    where: dict[str, list[int]] = defaultdict(list)
    for i in range(end - 1):
        if symbols[i] and symbols[i + 1]:
            counts[symbols[i] + symbols[i + 1]] += weight[i]
            where[symbols[i] + symbols[i + 1]].append(i)

    def replace(pair: str, new: str) -> set[str]:
        """Merge all occurrences from left to right; returns the pairs that are new."""
        touched: set[str] = set()
        for i in sorted(set(where.pop(pair))):
            j = after[i]
            if symbols[i] != pair[0] or symbols[j] != pair[1]:
                continue
            n, x, y = weight[i], before[i], after[j]
            left, right = symbols[x] if x >= 0 else "", symbols[y]
            counts[pair] -= n
            if left:
                counts[left + pair[0]] -= n
            if right:
                counts[pair[1] + right] -= n
            symbols[i], symbols[j], after[i], before[y] = new, None, y, i
            for place, made in ((x, left and left + new), (i, right and new + right)):
                if made:
                    counts[made] += n
                    where[made].append(place)
                    touched.add(made)
        return touched

    heap = [(-n, pair) for pair, n in counts.items() if (-n, pair) <= last]
    heapify(heap)
    accepted: list[tuple[str, str]] = []
    while heap and len(tokens) < vocab_size:
        n, pair = heappop(heap)
        place = (-counts[pair], pair)
        if place[0] != n:
            if place <= last:
                heappush(heap, place)
            continue
        new, seen = tokens.merge(pair)
        accepted.append((pair, new))
        if seen:
            break
        for p in replace(pair, new):
            if (-counts[p], p) <= last:
                heappush(heap, (-counts[p], p))
    return accepted


def independent_merges(ranked: list[tuple[str, int]], tokens: Tokens, vocab_size: int) -> list[tuple[str, str]]:
    """The longest start of the ranked pairs that may be merged together without looking at any word.

    A merge changes only the counts of pairs that overlap it, and a pair it creates is never more frequent
    than such an overlapping pair, so every pair up to the first overlap keeps its place. Used when even
    few pairs make too many runs.
    """
    lefts: set[str] = set()
    rights: set[str] = set()
    accepted: list[tuple[str, str]] = []
    for pair, _ in ranked:
        left, right = pair
        if len(tokens) >= vocab_size or left in rights or right in lefts:
            break
        new, seen = tokens.merge(pair)
        accepted.append((pair, new))
        if seen or left == right:
            break
        lefts.add(left)
        rights.add(right)
    return accepted


def train_vocabulary(words: DataFrame, config: VocabConfig = VocabConfig()) -> Vocabulary:
    """Learn a byte-pair vocabulary from ``words(word, n)``.

    The result is that of merging one pair at a time: the most frequent pair first, equal counts by
    smaller ids, until the vocabulary is full or no pair is frequent enough. It is reached in rounds over an
    index of the words (``PairIndex``):

    1. take the most frequent pairs from the counts that the index keeps;
    2. cut the words that hold them into runs of those pairs and count distinct runs;
    3. order all merges that these counts decide; the driver holds only this bounded summary;
    4. rewrite the words that hold them, and correct the counts of pairs by what changes.
    """
    if config.vocab_size > MAX_VOCAB:
        raise ValueError(f"vocab_size must not exceed {MAX_VOCAB}")
    spark = words.sparkSession
    small_batches(spark)
    words = stored(words, "training-words")
    alphabet = sorted(r["ch"] for r in top_alphabet(character_counts(words), config.limit_alphabet).collect())
    tokens = Tokens(alphabet)
    index = PairIndex(spread(words, "word").select(_as_symbols(F.col("word"), alphabet).alias("word"), "n"))
    lookahead = FIRST_PAIRS
    least = max(config.min_frequency, 1)
    while len(tokens) < config.vocab_size:
        ranked = index.top(MAX_PAIRS, least)
        if not ranked:
            break
        seen = ranked[:lookahead]
        complete = len(seen) == len(ranked) < MAX_PAIRS
        last = (-least, END_OF_SYMBOLS) if complete else (-seen[-1][1], seen[-1][0])
        runs, last = bounded_runs(index, seen, last)
        merges = certain_merges(runs, last, tokens, config.vocab_size)
        if not merges:
            merges = independent_merges(ranked, tokens, config.vocab_size)
        if len(runs) < MAX_RUNS // 4:
            lookahead = min(lookahead * (4 if len(runs) < MAX_RUNS // 16 else 2), MAX_PAIRS)
        if len(tokens) < config.vocab_size:
            index.merge(merges)
    spelled = tokens.spellings
    lefts, rights = ([spelled[pair[side]] for pair in tokens.merges] for side in (0, 1))
    return Vocabulary(
        with_special_tokens(_table(spark, id=range(len(spelled)), token=spelled)),
        _table(spark, rank=range(len(lefts)), left=lefts, right=rights),
    )


def _table(spark: SparkSession, **columns: Iterable) -> DataFrame:
    """Numbers, then texts, as a table. It is handed over as Arrow data; rows would go through Python workers of their own on the executors."""
    first, *_ = columns
    return spark.createDataFrame(pa.table({c: pa.array(list(values), pa.int32() if c == first else pa.string()) for c, values in columns.items()}))


def with_special_tokens(base: DataFrame) -> DataFrame:
    """Append ``<s>``, ``</s>`` and ``<pad>`` after the base vocabulary; ``<unk>`` keeps its id."""
    added = _table(base.sparkSession, nth=range(3), token=(BOS, EOS, PAD))
    size = base.agg((F.max("id") + 1).alias("size")).scalar()
    tail = added.select((size + F.col("nth")).cast("int").alias("id"), "token", F.lit(True).alias("is_special"))
    return base.select("id", "token", (F.col("token") == UNK).alias("is_special")).unionByName(tail)


def vocabulary_report(vocab: DataFrame) -> DataFrame:
    """Full and base size, and the ids of the special tokens."""

    def id_of(token):
        return F.max(F.when(F.col("token") == token, F.col("id")))

    added = F.col("token").isin(BOS, EOS, PAD) & F.col("is_special")
    return vocab.agg(
        F.count("*").alias("full_size"),
        F.count(F.when(~added, 1)).alias("base_size"),
        id_of(UNK).alias("unk_id"),
        id_of(BOS).alias("bos_id"),
        id_of(EOS).alias("eos_id"),
        id_of(PAD).alias("pad_id"),
    )
