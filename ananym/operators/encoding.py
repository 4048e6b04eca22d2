"""Text to token ids and back."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ananym.config import REVERSED, SPECIAL_TOKENS, UNK, WORD_MARK
from ananym.functions.text import may_change_under_nfkc
from ananym.operators.columnar import LITERAL, Encoder, slices, split_words
from ananym.operators.pair_index import taken
from ananym.operators.rows import require_orientation, reverse_rows
from ananym.operators.vocabulary import MAX_VOCAB, Vocabulary
from ananym.session import FAT_ROWS, small_batches, stored

# Text that is encoded together by word, and what a row counts for beside its text.
BLOCK_BYTES = 4 << 20
ROW_BYTES = 64
# Spark numbers rows by task and, in the lower bits, inside the task.
TASK_SHIFT = 33
GROUP_TASKS = 1024
# Has no effect any more: frequent words are not broadcast but take the way of the others. A test still sets it.
HEAD_WORDS = 400_000
MAX_SPELLING_CHARS = 16 << 20

BY_WORD = "by_word"
BY_DOCUMENT = "by_document"


def merge_table(vocabulary: Vocabulary) -> tuple[dict, dict]:
    """A vocabulary as lookups for one task: token to id, and id pair to rank and new id.

    Bounded by the vocabulary size; never grows with the corpus.
    """
    tokens = vocabulary.vocab.select("token", "id").limit(MAX_VOCAB + 1).toArrow()
    if len(tokens) > MAX_VOCAB:
        raise ValueError(f"a vocabulary must not exceed {MAX_VOCAB} tokens")
    ids = dict(zip(tokens["token"].to_pylist(), tokens["id"].to_pylist()))
    merges = vocabulary.merges.orderBy("rank").toArrow()
    ordered = zip(*(merges[name].to_pylist() for name in ("rank", "left", "right")))
    return ids, {(ids[left], ids[right]): (rank, ids[left + right]) for rank, left, right in ordered}


def encode_word(word: str, token_ids: dict, pairs: dict) -> list[int]:
    """Ids of one word: the merge of lowest rank first, leftmost first; an unknown character is one ``<unk>``."""
    if word in SPECIAL_TOKENS:
        return [token_ids[word]]
    unknown = token_ids[UNK]
    ids = [token_ids.get(ch, unknown) for ch in word]
    end = len(ids)
    following = list(range(1, end + 1))
    preceding = list(range(-1, end - 1))
    queue = [(*pairs[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
    heapify(queue)
    while queue:
        rank, new, i = heappop(queue)
        j = following[i]
        if ids[i] is None or j == end or pairs.get((ids[i], ids[j])) != (rank, new):
            continue
        ids[i], ids[j] = new, None
        k = following[i] = following[j]
        if k < end:
            preceding[k] = i
        for a, b in ((preceding[i], i), (i, k)):
            if a >= 0 and b < end and (ids[a], ids[b]) in pairs:
                heappush(queue, (*pairs[ids[a], ids[b]], a))
    return [i for i in ids if i is not None]


def _encoder(table: tuple[dict, dict]) -> Encoder:
    token_ids, pairs = table
    return Encoder(token_ids, pairs, lambda word: encode_word(word, token_ids, pairs))


def word_tokens(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Add ``ids`` to a table of distinct words, in Arrow batches."""
    table = merge_table(vocabulary)

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(table)
        for batch in batches:
            special = np.asarray(pc.is_in(batch, pa.array(SPECIAL_TOKENS)))
            tokens = batch.filter(pa.array(special)).to_pylist()
            marked = pc.replace_substring(batch.filter(pa.array(~special)), WORD_MARK, "")
            yield encoder.placed(marked, np.arange(len(batch) + 1), (np.flatnonzero(special) - np.arange(len(tokens)), tokens))

    return words.withColumn("ids", ids_of("word"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Kept columns and texts of consecutive rows, about ``BLOCK_BYTES`` together; a longer text stands alone."""
    held: list[tuple[pa.Array, pa.Array]] = []
    size = 0
    together = lambda: tuple(pa.concat_arrays(column) for column in zip(*held))
    for batch in batches:
        start = 0
        for part in slices(pc.fill_null(batch.column("text").cast(pa.string()), ""), BLOCK_BYTES):
            # Short texts count for what is kept of them, too.
            own = pc.sum(pc.binary_length(part)).as_py() + ROW_BYTES * len(part)
            if held and size + own > BLOCK_BYTES:
                yield together()
                held, size = [], 0
            held.append((batch.column("kept").slice(start, len(part)), part))
            start, size = start + len(part), size + own
    if held:
        yield together()


def _placed_words(texts: pa.Array, first_words: int | None, match_special: bool) -> tuple[pa.Array, np.ndarray]:
    """Marked words and literal special tokens of all texts one after another, and how many each text has."""
    rows = [LITERAL.split(t) for t in texts.to_pylist()] if match_special else []
    own = pa.array([segment for row in rows for segment in row[::2]], pa.string()) if match_special else texts
    words, counts = split_words(own, first_words)
    marked = pc.binary_join_element_wise(WORD_MARK, words, "") if len(words) else words
    if not match_special:
        return marked, counts
    tokens = [token for row in rows for token in row[1::2]]
    after, inside = np.cumsum(counts), np.array([len(row) // 2 for row in rows])
    last = np.cumsum(inside + 1) - 1
    before = after[np.setdiff1d(np.arange(len(counts)), last)]
    spaced = np.insert(np.arange(len(marked)), before, len(marked) + np.arange(len(tokens)))
    marked = pa.concat_arrays([marked, pa.array(tokens, pa.string())]).take(pa.array(spaced))
    return marked, np.diff(after[last] + np.cumsum(inside), prepend=0)


def _blocks(df: DataFrame, keep: list[str], first_words: int | None, match_special: bool) -> DataFrame:
    """Neighbouring documents as one row: their distinct words, and for each word of each in order which of these it is."""
    kept = ", ".join(f"`{c}`: {df.schema[c].dataType.simpleString()}" for c in keep)
    own = f"own struct<kept: array<struct<{kept}>>, counts: binary, places: binary>"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for documents, texts in _gathered(batches):
            marked, counts = _placed_words(texts, first_words, match_special)
            coded = marked.dictionary_encode()
            columns = {"kept": _one_list(documents), "counts": _bytes(counts), "places": _bytes(np.asarray(coded.indices))}
            yield pa.RecordBatch.from_pydict({"words": _one_list(coded.dictionary), "own": pa.StructArray.from_arrays(list(columns.values()), list(columns))})

    packs = df.select(F.struct(*keep).alias("kept"), "text").mapInArrow(packed, f"words array<string>, {own}")
    return stored(packs.select(F.monotonically_increasing_id().alias("block"), "words", "own"), "blocks", FAT_ROWS)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _bytes(numbers: np.ndarray) -> pa.Array:
    """Numbers below 2**31 as one value; their first bytes stand together, then their second ones, which compresses well."""
    return pa.array([numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary())


def _numbers(value: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(value.as_buffer(), np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


def _laid_out(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Documents with their ids, from the row of each block and after it the ids of the block's words in their order."""

    def whole(own: dict[str, pa.Scalar], parts: list[pa.Array]) -> pa.RecordBatch:
        ids = pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(part.cast(pa.list_(pa.int32())) for part in parts)])
        lengths = np.asarray(pc.list_value_length(ids), dtype=np.int64)
        counts, codes = _numbers(own["counts"]), _numbers(own["places"])
        places, ends = taken((np.cumsum(lengths) - lengths)[codes], lengths[codes])
        bounds = ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]
        listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ids.flatten().take(pa.array(places)))
        return pa.RecordBatch.from_arrays([*own["kept"].values.flatten(), listed], [*keep, "input_ids"])

    own, parts = None, []
    for batch in batches:
        start = 0
        for row in np.flatnonzero(np.asarray(batch.column("nth")) < 0).tolist():
            if own is not None:
                yield whole(own, [*parts, batch.column("ids").slice(start, row - start)])
            own, parts, start = batch.column("own")[row], [], row + 1
        parts.append(batch.column("ids").slice(start))
    if own is not None:
        yield whole(own, parts)


def _encode_by_word(df, vocabulary, keep, first_words, match_special) -> DataFrame:
    """Encode each distinct word of the corpus once, and give each block of documents the ids of its own distinct words.

    Documents are read once and stored in blocks, as their distinct words and where these stand; only (block, distinct word)
    rows are shuffled: to their word, which gets its ids, and back to their block, in the order of its words. Nothing is
    broadcast, and no task holds more than one block beside what Spark sorts and may spill. ``by_document`` needs no
    shuffle and is the better choice unless words are very costly to encode.
    """
    small_batches(df.sparkSession)
    blocks = _blocks(df, keep, first_words, match_special)
    placed = blocks.select("block", F.posexplode("words").alias("nth", "word"))
    # The upper bits of a block's number tell the task that wrote it. A word that is in all blocks has a group for each GROUP_TASKS tasks.
    tasks = F.shiftright("block", TASK_SHIFT + GROUP_TASKS.bit_length() - 1)
    grouped = placed.groupBy("word", tasks.alias("tasks")).agg(F.collect_list(F.struct("block", "nth")).alias("places"))
    found = word_tokens(grouped.select("word", "places"), vocabulary).select(F.inline("places"), "ids")
    rows = found.withColumn("own", F.lit(None).cast(blocks.schema["own"].dataType)).unionByName(
        blocks.select("block", F.lit(-1).alias("nth"), F.lit(None).cast("array<int>").alias("ids"), "own")
    )
    schema = StructType([*(df.schema[c] for c in keep), StructField("input_ids", ArrayType(IntegerType()))])
    in_order = rows.repartition("block").sortWithinPartitions("block", "nth").select("nth", "ids", "own")
    return in_order.mapInArrow(lambda batches: _laid_out(batches, keep), schema)


def _encode_by_document(df, vocabulary, keep, first_words, match_special) -> DataFrame:
    """Encode documents where they are, in Arrow batches: no shuffle, and the distinct words of a batch are encoded together."""
    table = merge_table(vocabulary)

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(table)
        for batch in batches:
            yield from encoder.parts(batch, first_words, match_special)

    # Keeps the optimiser from copying the call into every later use of the ids.
    ids_of = ids_of.asNondeterministic()
    text = F.col("text")
    if first_words is not None:
        # Normalising may add spaces but takes none away, and a part that ends before a space normalises alone.
        text = F.substring_index(text, " ", first_words + 2)
    return df.select(*keep, ids_of(text).alias("input_ids"))


def encode(
    df: DataFrame,
    vocabulary: Vocabulary,
    keep: tuple[str, ...] = ("doc_id",),
    strategy: str = BY_DOCUMENT,
    first_words: int | None = None,
    match_special: bool = False,
) -> DataFrame:
    """Add ``input_ids`` to documents that already read right to left. No start or end token is added.

    ``keep`` holds a unique key and whatever else is to stay; the text is dropped. ``first_words``, for
    truncation only, stops after that many words. ``match_special`` takes special tokens spelled in the
    text for the tokens themselves; leave it off for text from the web.
    """
    df = require_orientation(df, REVERSED)
    run = {BY_WORD: _encode_by_word, BY_DOCUMENT: _encode_by_document}[strategy]
    return run(df, vocabulary, list(keep), None if match_special else first_words, match_special)


def reverse_and_encode(df: DataFrame, vocabulary: Vocabulary, **options) -> DataFrame:
    """For documents stored in reading order."""
    return encode(reverse_rows(df), vocabulary, **options)


def may_fill_context(text: Column, context_length: int) -> Column:
    """False for texts surely too short to give ``context_length`` tokens: each token covers a character or the first mark.

    Normalising may lengthen a text; those it may change are let through.
    """
    return text.isNotNull() & ((F.length(text) + 1 >= context_length) | may_change_under_nfkc(text))


def spellings(vocabulary: Vocabulary) -> Column:
    """All token spellings in id order as one constant array; checked to be small enough to be part of a plan."""
    size = vocabulary.vocab.agg(F.coalesce(F.sum(F.length("token")), F.lit(0)).alias("n")).first()["n"]
    if size > MAX_SPELLING_CHARS:
        raise ValueError("the vocabulary is too large to hand to every task")
    tokens = [r["token"] for r in vocabulary.vocab.orderBy("id").collect()]
    joined = "".join(tokens)
    between = next(c for c in map(chr, range(0x10FFFF, 0xF0000, -1)) if c not in joined)
    return F.split(F.lit(between.join(tokens)), between)


def token_strings(df: DataFrame, vocabulary: Vocabulary, ids: str = "input_ids") -> DataFrame:
    """Add ``tokens``, the spelling of each id."""
    table = spellings(vocabulary)
    return df.withColumn("tokens", F.transform(ids, lambda i: F.element_at(table, i + 1)))


def decode(df: DataFrame, vocabulary: Vocabulary, skip_special: bool = False, ids: str = "input_ids") -> DataFrame:
    """Add ``text``: spellings joined, marks as spaces, the first mark dropped."""
    table = spellings(vocabulary)
    kept = F.col(ids)
    if skip_special:
        rows = vocabulary.vocab.where("is_special").select("id").collect()
        special = F.array(*[F.lit(r["id"]) for r in rows])
        kept = F.filter(kept, lambda i: ~F.array_contains(special, i))
    joined = F.array_join(F.transform(kept, lambda i: F.element_at(table, i + 1)), "")
    unmarked = F.when(joined.startswith(WORD_MARK), F.substring(joined, 2, 2**31 - 1)).otherwise(joined)
    return df.withColumn("text", F.translate(unmarked, WORD_MARK, " "))
