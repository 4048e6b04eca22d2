"""

Every query runs over its whole tables. Vocabulary and encoding queries are registered twice: under names ending in
``_full`` at the operator's own size, without SQL, as a recursive query can't learn so many merges; and under plain names at
``VOCAB_CAP`` tokens, which is only what the recursive SQL can check.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ananym.config import VOCAB_SIZE, BatchConfig, VocabConfig
from ananym.functions.arrays import chunked
from ananym.functions.hashing import fraction_limit
from ananym.functions.text import may_change_under_nfkc, nfkc, prefix, prefix_reversed, read_back, words
from ananym.operators.batches import assign_batches, collate, epoch_order, shuffled_batches
from ananym.operators.encoding import BY_DOCUMENT, BY_WORD, decode, encode, reverse_and_encode, token_strings
from ananym.operators.limits import (
    random_rows,
    row_at,
    sample_rows,
    split_exact,
    split_hash,
    take_first,
)
from ananym.operators.order import rows_at, write_key_ranges
from ananym.operators.reports import corpus_report, length_report, loss_history, observed, step_report, token_report
from ananym.operators.rows import (
    explode_rows,
    map_batches,
    map_rows,
    remove_columns,
    reverse_rows,
    select_columns,
)
from ananym.operators.sequences import (
    CHUNK,
    TRUNCATE,
    chunk_sequences,
    fit_context,
    full_length_only,
    truncate_sequences,
)
from ananym.operators.vocabulary import Vocabulary, vocabulary_report
from ananym.operators.words import (
    character_counts,
    initial_ids,
    pair_counts,
    restrict_to_alphabet,
    top_alphabet,
    training_text,
    word_counts,
)
from ananym.plans import prepare_corpus, tokenise_corpus, train_tokenizer, training_batches
from ananym.session import scratch_path, spread, stored
from ananym.sources.corpus import (
    bundle_splits,
    disk_order,
    keep_copy,
    read_corpus,
    read_split_files,
    read_splits,
    store_with_keys,
    write_shuffled,
    write_splits,
)
from ananym.sources.logs import read_log
from ananym.sources.vocabulary import load_vocabulary, read_tokenizer_file, save_vocabulary, write_tokenizer_file
from ananym.streaming.files import counting_rows, cut_stream, encode_stream, prepare_stream, progress, stream_corpus, write_available
from ananym.streaming.ledger import ledger_schema, ledger_totals, write_counted

VOCAB_CAP = 150
CONTEXT = 64
BATCH = 8


# --- inputs ---------------------------------------------------------------------------------------


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_corpus(spark, f"{sf}/documents.parquet")


def reversed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return reverse_rows(spread(documents(spark, sf), "doc_id"))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


def word_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with an int array that SQL can rebuild: the lengths of their space-separated parts."""
    lengths = F.transform(F.split("text", " "), lambda w: F.length(w))
    return documents(spark, sf).select("doc_id", lengths.alias("input_ids"))


def joined(column: str) -> F.Column:
    return F.concat_ws(",", F.col(column).cast("array<string>"))


_trained: dict[tuple[str, str, int], str] = {}


def vocabulary(spark: SparkSession, sf: str, size: int = VOCAB_CAP) -> Vocabulary:
    """Vocabulary of all documents, trained once per session, folder and size and then read from its saved tables."""
    key = (spark.sparkContext.applicationId, sf, size)
    if key not in _trained:
        trained = train_tokenizer(
            reversed_documents(spark, sf).withColumn("split", F.lit("train")), VocabConfig(vocab_size=size)
        )
        path = scratch_path(spark, "vocabulary")
        save_vocabulary(trained, path)
        _trained[key] = path
    return load_vocabulary(spark, _trained[key])


# --- sources and sinks ----------------------------------------------------------------------------


def read_json_lines(spark, sf):
    path = scratch_path(spark, "json")
    documents(spark, sf).write.option("compression", "gzip").json(path)
    return read_corpus(spark, path, "json")


def read_text_lines(spark, sf):
    """Lines with the count of their rows and of their distinct keys, over a corpus with several files."""
    path = scratch_path(spark, "text")
    texts = documents(spark, sf).select("text")
    # Only a small table needs dealing out; any other is written in as many files as it scans in tasks.
    texts = texts if texts.rdd.getNumPartitions() >= 4 else texts.repartition(4, "text")
    texts.write.text(path)
    lines = read_corpus(spark, path, "text")
    keys = lines.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("text").alias("text"))
    return keys.groupBy("text").agg(F.sum("rows").alias("n"), F.count("*").alias("n_keys"))


def keyless_split(spark, sf):
    """A corpus stored without keys gets some; sizes of the exact split and of the first 300 rows of it."""
    bare, keyed = scratch_path(spark, "bare"), scratch_path(spark, "keyed")
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    items.select(F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text")).write.json(bare)
    corpus = store_with_keys(read_corpus(spark, bare, "json"), keyed)
    sizes = split_exact(corpus, 0.1).groupBy("split").agg(F.count("*").alias("n"))
    return sizes.unionByName(take_first(corpus, 300).agg(F.lit("first").alias("split"), F.count("*").alias("n")))


def order_texts(spark, sf):
    """Orders under a key of text: zero-padded numbers, reversed so that their order differs from that of the numbers."""
    number = F.reverse(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return spark.read.parquet(f"{sf}/orders.parquet").select(number.alias("name"), "o_orderkey")


def small_fraction(spark, sf):
    """A hundred-thousandth of a hundred rows per line item."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    # What the copies of an item share is put together before there are a hundred of them.
    named = items.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item"))
    wide = spread(named, "item").select("item", F.explode(F.array(*[F.lit(f"-{i}") for i in range(100)])).alias("copy"))
    return sample_rows(wide.select(F.concat("item", "copy").alias("doc_id")), 1e-5, seed=1)


def stream_progress(spark, sf):
    """Rows that a stream of several files reports, counted over all its batches."""
    path, files = scratch_path(spark, "stream"), scratch_path(spark, "many-files")
    documents(spark, sf).repartition(6, "doc_id").write.parquet(files)
    counter = counting_rows(spark)
    query = write_available(prepare_stream(stream_corpus(spark, files, "*.parquet", max_files_per_trigger=1), 0.1), path)
    rows = progress(query, counter)
    spark.streams.removeListener(counter)
    return spark.createDataFrame([(rows,)], "n_rows bigint")


def read_subset(spark, sf):
    path = scratch_path(spark, "by-language")
    spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").write.partitionBy("lang").parquet(path)
    return read_corpus(spark, path, schema=None, subset=F.col("lang") == "fr").select("doc_id", "text", "lang")


def keep_local_copy(spark, sf):
    return keep_copy(documents(spark, sf), scratch_path(spark, "copy"))


def split_files(spark, sf):
    path = scratch_path(spark, "split-files")
    split = split_hash(documents(spark, sf), 0.1)
    for name in ("train", "valid"):
        split.where(F.col("split") == name).select("doc_id", "text").write.parquet(f"{path}/{name}")
    return read_split_files(spark, {"train": f"{path}/train", "valid": f"{path}/valid"})


def write_and_read_splits(spark, sf):
    path = scratch_path(spark, "splits")
    write_splits(prepare_corpus(documents(spark, sf)), path)
    return read_splits(spark, path).select("doc_id", "text", "split", "orientation")


def reopen_split(spark, sf):
    path = scratch_path(spark, "splits")
    write_splits(prepare_corpus(documents(spark, sf)), path)
    return read_splits(spark, path, "valid").select("doc_id", "text")


def shuffled_splits(spark, sf):
    """Splits written in shuffled order, and the order in which their rows lie on disk."""
    path = scratch_path(spark, "shuffled")
    write_shuffled(split_exact(documents(spark, sf), 0.1), path, seed=7)
    return disk_order(spark.read.parquet(path), by=("split",)).select("doc_id", "split", "position", "disk_order")


def indexed_rows(spark, sf):
    """Rows at several positions, by an index of key ranges."""
    texts = order_texts(spark, sf)
    ranges = write_key_ranges(texts, scratch_path(spark, "ranges"), "name", rows_per_range=1000)
    return rows_at(texts, ranges, [0, 7, 5_000, 11_111, 10**9], "name")


def bundled_splits(spark, sf):
    """One table per role, bundled under the role's name."""
    turns = conversations(spark, sf)
    roles = [r["role"] for r in turns.select("role").distinct().orderBy("role").collect()]
    return bundle_splits({role: turns.where(F.col("role") == role).select("conv_id", "turn") for role in roles})


def vocabulary_saved(spark, sf, size=VOCAB_CAP):
    path = scratch_path(spark, "vocabulary-copy")
    save_vocabulary(vocabulary(spark, sf, size), path)
    return load_vocabulary(spark, path).vocab


def tokenizer_file(spark, sf, size=VOCAB_CAP):
    """The vocabulary after a round trip through the public library's file."""
    path = scratch_path(spark, "tokenizer-file")
    write_tokenizer_file(vocabulary(spark, sf, size), path)
    return read_tokenizer_file(spark, path).vocab


def _written_log(spark, sf) -> DataFrame:
    """A training log made from ``events``: one run per event type, ``error`` events as evaluation entries."""
    path = scratch_path(spark, "log")
    value = F.col("value").cast("decimal(18,4)").cast("string")
    name = F.when(F.col("event_type") == "error", "eval_loss").otherwise("loss")
    line = F.concat(F.lit("{'"), name, F.lit("': "), value, F.lit(", 'grad_norm': 0.5}"))
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.when(F.col("event_type").isin("click", "error"), "a").otherwise("b").alias("run"), line.alias("value")
    )
    ordered = events.repartitionByRange("run", "event_id").sortWithinPartitions("run", "event_id")
    ordered.select("run", "value").write.partitionBy("run").text(path)
    return read_log(spark, path)


def training_log(spark, sf):
    return _written_log(spark, sf).groupBy("run", "value").agg(F.count("*").alias("n"))


def loss_curve(spark, sf):
    return loss_history(_written_log(spark, sf))


# --- rows and text --------------------------------------------------------------------------------


def conversation_reverse(spark, sf):
    return conversations(spark, sf).select("conv_id", "turn", read_back(F.col("text")).alias("text"))


def map_rows_native(spark, sf):
    return map_rows(documents(spark, sf), {"text": F.translate("text", "\n", " "), "size": F.length("text")})


def map_batches_lines(spark, sf):
    """More rows out than in: the lines of each document."""

    def lines(batch):
        return batch.assign(line=batch["text"].str.split("\n")).explode("line")[["doc_id", "line"]]

    return map_batches(documents(spark, sf), lines, "doc_id long, line string", batch_size=32)


def map_batches_native(spark, sf):
    return explode_rows(documents(spark, sf), F.split("text", "\n"), "place", "line", ["doc_id"])


def nfkc_text(spark, sf):
    text = F.col("text")
    return documents(spark, sf).select("doc_id", nfkc(text).alias("text"), may_change_under_nfkc(text).alias("may_change"))


def observed_totals(spark, sf):
    """Counts taken while the corpus is written."""
    watched, watch = observed(documents(spark, sf), "corpus")
    watched.write.parquet(scratch_path(spark, "observed"))
    return spark.createDataFrame([(watch.get["n_rows"], watch.get["n_chars"])], "n_rows bigint, n_chars bigint")


# --- words and vocabulary -------------------------------------------------------------------------


def words_of(spark, sf):
    return word_counts(reversed_documents(spark, sf))


def split_words(spark, sf):
    corpus = split_hash(reversed_documents(spark, sf), 0.1)
    return word_counts(training_text(corpus))


def pretokenised(spark, sf):
    return reversed_documents(spark, sf).select("doc_id", F.posexplode(words(F.col("text"))).alias("place", "word"))


def alphabet_restricted(spark, sf):
    counted = stored(words_of(spark, sf), "words")
    kept = restrict_to_alphabet(counted, top_alphabet(character_counts(counted), 40))
    return kept.groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))


def alphabet_ids(spark, sf):
    return initial_ids(top_alphabet(character_counts(words_of(spark, sf)))).select(F.col("id").cast("bigint"), "token")


def restricted_pairs(spark, sf):
    return pair_counts(alphabet_restricted(spark, sf))


# --- encoding -------------------------------------------------------------------------------------


def encoded(spark, sf, strategy=BY_DOCUMENT, size=VOCAB_CAP) -> DataFrame:
    return encode(reversed_documents(spark, sf), vocabulary(spark, sf, size), strategy=strategy)


def ids_as_text(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.size("input_ids").alias("n_ids"), joined("input_ids").alias("ids"))


def encoded_tokens(spark, sf, size=VOCAB_CAP):
    shown = token_strings(encoded(spark, sf, size=size), vocabulary(spark, sf, size))
    return shown.select("doc_id", F.concat_ws("|", "tokens").alias("tokens"))


def decoded(spark, sf, size=VOCAB_CAP):
    return decode(encoded(spark, sf, size=size), vocabulary(spark, sf, size)).select("doc_id", "text")


def decoded_without_special(spark, sf, size=VOCAB_CAP):
    vocab = vocabulary(spark, sf, size)
    special = vocab.vocab.where("is_special").orderBy("id").select("id").collect()
    marks = F.array(*[F.lit(r["id"]) for r in special])
    framed = encoded(spark, sf, size=size).withColumn("input_ids", F.concat(marks, "input_ids", marks))
    return decode(framed, vocab, skip_special=True).select("doc_id", "text")


def special_matched(spark, sf, size=VOCAB_CAP):
    """Literal special tokens of all kinds at the ends of each document and between its halves, cut at a space."""
    texts = reversed_documents(spark, sf)
    middle = F.expr("locate(' ', text, cast(floor(length(text) / 2) AS int) + 1)")
    tail = F.when(F.col("middle") > 0, F.expr("substring(text, middle)")).otherwise(F.lit(""))
    texts = texts.withColumn("middle", middle)
    head = F.when(F.col("middle") > 0, F.expr("substring(text, 1, middle - 1)")).otherwise(F.col("text"))
    marked = F.concat(F.lit("</s>"), head, F.lit("<unk><pad>"), tail, F.lit("<s>"))
    return ids_as_text(encode(texts.withColumn("text", marked), vocabulary(spark, sf, size), match_special=True))


def stored_forward(spark, sf, size=VOCAB_CAP):
    corpus = spread(documents(spark, sf), "doc_id")
    return ids_as_text(reverse_and_encode(corpus, vocabulary(spark, sf, size)))


def probe_texts(spark, sf, size=VOCAB_CAP):
    texts = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    return ids_as_text(encode(texts, vocabulary(spark, sf, size)))


def token_table(spark, sf, mode, context=CONTEXT, size=VOCAB_CAP) -> DataFrame:
    corpus = reversed_documents(spark, sf).withColumn("split", F.lit("train"))
    return tokenise_corpus(corpus, vocabulary(spark, sf, size), context, mode)


def sequences_as_text(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("chunk").cast("bigint"), "length", joined("input_ids").alias("ids"))


# --- sequences, batches ---------------------------------------------------------------------------


def chunks(spark, sf) -> DataFrame:
    return chunk_sequences(word_lengths(spark, sf), CONTEXT)


def truncated_rows(spark, sf) -> DataFrame:
    return fit_context(word_lengths(spark, sf), CONTEXT, TRUNCATE)


def filled_windows(spark, sf):
    """Windows by plain slicing, the short ones then filtered out."""
    ids = F.col("input_ids")
    starts = F.sequence(F.lit(0), F.size(ids), F.lit(CONTEXT))
    windows = F.transform(starts, lambda i: F.slice(ids, i + 1, F.lit(CONTEXT)))
    cut = word_lengths(spark, sf).select("doc_id", F.posexplode(windows).alias("chunk", "input_ids"))
    return full_length_only(cut, CONTEXT).select("doc_id", "chunk", joined("input_ids").alias("ids"))


def lengths_report(spark, sf):
    """Both modes at three contexts, from one scan."""
    contexts = F.explode(F.array(*[F.lit(c) for c in (1024, 4096, CONTEXT)])).alias("context")
    wide = word_lengths(spark, sf).select(F.size("input_ids").alias("size"), contexts)
    modes = F.explode(F.array(F.lit(CHUNK), F.lit(TRUNCATE))).alias("mode")
    return length_report(wide.select("size", "context", modes))


def epoch_steps(spark, sf):
    return step_report(split_hash(chunks(spark, sf), 0.1), BatchConfig(per_device=5, devices=2))


def ordered_epoch(spark, sf):
    return epoch_order(chunks(spark, sf), seed=0, epoch=1).select("doc_id", "chunk", "position")


def epoch_batches(spark, sf):
    ordered = epoch_order(truncated_rows(spark, sf), seed=0, epoch=0, keys=("doc_id",))
    return assign_batches(ordered, BATCH).select("doc_id", "position", "batch_id")


def padded_batches(spark, sf):
    ordered = assign_batches(epoch_order(truncated_rows(spark, sf), keys=("doc_id",)), BATCH)
    return collate(ordered, pad_id=0).select(
        "doc_id", "batch_id", *[joined(c).alias(c) for c in ("input_ids", "attention_mask", "labels")]
    )


def padded_epoch(spark, sf):
    batches = shuffled_batches(truncated_rows(spark, sf), BATCH, pad_id=0, keys=("doc_id",))
    return batches.select("doc_id", "position", "batch_id", *[joined(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


def token_batches(spark, sf, size=VOCAB_CAP):
    """The whole way: documents to padded batches of real token ids."""
    tokens = stored(token_table(spark, sf, TRUNCATE, size=size), "tokens")
    batches = training_batches(tokens, vocabulary(spark, sf, size), BATCH)
    return batches.select(
        "batch_id", "position", "doc_id", F.size("input_ids").alias("width"), joined("input_ids").alias("input_ids")
    )


# --- streams --------------------------------------------------------------------------------------


def stream_prepare(spark, sf):
    """The table is one file or a folder of them; to a stream only a pattern may name either."""
    path = scratch_path(spark, "stream")
    write_available(prepare_stream(stream_corpus(spark, f"{sf}/documents.parque[t]"), 0.1), path, partition_by=["split"])
    return read_splits(spark, path).select("doc_id", "text", "split")


def stream_chunks(spark, sf):
    path, tokens = scratch_path(spark, "stream"), scratch_path(spark, "tokens")
    table = word_lengths(spark, sf)
    table.write.parquet(tokens)
    write_available(cut_stream(stream_corpus(spark, tokens, "*.parquet", table.schema), CONTEXT, CHUNK), path)
    return sequences_as_text(spark.read.parquet(path))


def _many_files(spark, sf) -> DataFrame:
    """The documents as a stream of several batches, prepared."""
    files = scratch_path(spark, "many-files")
    documents(spark, sf).repartition(6, "doc_id").write.parquet(files)
    return prepare_stream(stream_corpus(spark, files, "*.parquet", max_files_per_trigger=2), 0.1)


def _counted(spark, stream: DataFrame, measures: dict) -> DataFrame:
    path, ledger, checkpoint = (scratch_path(spark, name) for name in ("stream", "ledger", "stream-checkpoint"))
    write_counted(stream, path, ledger, checkpoint, ("split",), measures)
    return ledger_totals(spark, ledger, ledger_schema(stream, ("split",), tuple(measures)), ("split",))


def stream_ledger(spark, sf):
    return _counted(spark, _many_files(spark, sf), {"n_chars": F.length("text")})


def stream_tokens(spark, sf, size=VOCAB_CAP):
    return _counted(spark, encode_stream(_many_files(spark, sf), vocabulary(spark, sf, size)), {"n_tokens": F.size("input_ids")})


def entry(spark: SparkSession) -> DataFrame:
    """Rows and characters per split of the prepared corpus."""
    return corpus_report(prepare_corpus(documents(spark, "/root/testdata/sf0.001")))


def _vocabulary_queries(size: int) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries that train a vocabulary of at most ``size`` tokens or read one."""
    return {
        "vocabulary_saved": partial(vocabulary_saved, size=size),
        "bpe_merges": lambda s, sf: vocabulary(s, sf, size).merges,
        "bpe_vocab": lambda s, sf: vocabulary(s, sf, size).vocab,
        "vocabulary_report": lambda s, sf: vocabulary_report(vocabulary(s, sf, size).vocab),
        # encoding
        "bpe_encode": lambda s, sf: ids_as_text(encoded(s, sf, size=size)),
        "bpe_encode_by_word": lambda s, sf: ids_as_text(encoded(s, sf, BY_WORD, size)),
        "bpe_encode_forward": partial(stored_forward, size=size),
        "bpe_encode_special": partial(special_matched, size=size),
        "bpe_encode_probes": partial(probe_texts, size=size),
        "bpe_tokens": partial(encoded_tokens, size=size),
        "bpe_decode": partial(decoded, size=size),
        "bpe_decode_skip_special": partial(decoded_without_special, size=size),
        "tokenise_truncate": lambda s, sf: sequences_as_text(token_table(s, sf, TRUNCATE, size=size)),
        "tokenise_chunk": lambda s, sf: sequences_as_text(token_table(s, sf, CHUNK, size=size)),
        "tokenise_report": lambda s, sf: token_report(token_table(s, sf, CHUNK, size=size), CONTEXT),
        "token_batches": partial(token_batches, size=size),
        "tokenizer_file": partial(tokenizer_file, size=size),
        "stream_tokens": partial(stream_tokens, size=size),
    }


def _training_data(kind: str) -> dict:
    """Queries that need no SQL here, or their SQL: vocabularies of full size, and the subpackage for training data and its pipeline, if there."""
    found: dict = {}
    if kind == "queries":
        found |= {f"{name}_full": query for name, query in _vocabulary_queries(VOCAB_SIZE).items()}
    for name in ("ananym.llm.queries", "corpus_pipeline"):
        try:
            module = importlib.import_module(name)
        except ModuleNotFoundError as error:
            if error.name not in ("ananym.llm", "ananym.llm.queries", "corpus_pipeline"):
                raise
        else:
            found |= getattr(module, kind)()
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # sources and sinks
        "read_parquet": documents,
        "read_json_lines": read_json_lines,
        "read_text_lines": read_text_lines,
        "read_subset": read_subset,
        "keyless_split": keyless_split,
        "keep_local_copy": keep_local_copy,
        "read_split_files": split_files,
        "write_splits": write_and_read_splits,
        "reopen_split": reopen_split,
        "write_shuffled": shuffled_splits,
        "rows_by_index": indexed_rows,
        "bundle_splits": bundled_splits,
        "training_log": training_log,
        # rows and text
        "select_columns": lambda s, sf: select_columns(documents(s, sf), "text"),
        "remove_columns": lambda s, sf: remove_columns(s.read.parquet(f"{sf}/documents.parquet"), ["text", "source"]),
        "map_rows": map_rows_native,
        "map_batches": map_batches_lines,
        "map_batches_native": map_batches_native,
        "reverse_text": lambda s, sf: reverse_rows(documents(s, sf)),
        "conversation_reverse": conversation_reverse,
        "prefix": lambda s, sf: documents(s, sf).select("doc_id", prefix(F.col("text"), 100).alias("text")),
        "prefix_reversed": lambda s, sf: documents(s, sf).select("doc_id", prefix_reversed(F.col("text"), 500).alias("text")),
        "full_length_only": filled_windows,
        # limits, samples, splits
        "take_first": lambda s, sf: take_first(documents(s, sf).select("doc_id"), 100),
        "take_many": lambda s, sf: take_first(documents(s, sf), 2_000_000),
        "take_many_lines": lambda s, sf: take_first(
            s.read.parquet(f"{sf}/orders.parquet").select("o_orderkey"), 2_000_000, "o_orderkey"
        ),
        "split_exact": lambda s, sf: split_exact(documents(s, sf), 0.1).select("doc_id", "split"),
        "split_exact_small": lambda s, sf: split_exact(documents(s, sf), 0.005).select("doc_id", "split"),
        "split_hash": lambda s, sf: split_hash(documents(s, sf), 0.1).select("doc_id", "split"),
        "row_at": lambda s, sf: row_at(documents(s, sf), 0).unionByName(row_at(documents(s, sf), 5)),
        "random_rows": lambda s, sf: random_rows(documents(s, sf), 10, seed=3),
        "take_first_by_text": lambda s, sf: take_first(order_texts(s, sf), 12_345, "name"),
        "row_at_by_text": lambda s, sf: row_at(order_texts(s, sf), 11_111, "name"),
        "take_most_lines": lambda s, sf: take_first(s.read.parquet(f"{sf}/orders.parquet").select("o_orderkey"), 12_345, "o_orderkey"),
        "sample_small_fraction": small_fraction,
        "sample_hash": lambda s, sf: sample_rows(documents(s, sf), 0.25, seed=1).select("doc_id"),
        "corpus_report": lambda s, sf: corpus_report(prepare_corpus(documents(s, sf))),
        "observed_totals": observed_totals,
        # words and vocabulary
        "training_text": lambda s, sf: training_text(split_hash(documents(s, sf), 0.1)),
        "nfkc": nfkc_text,
        "pretokenise": pretokenised,
        "word_counts": words_of,
        "word_counts_train": split_words,
        "character_counts": lambda s, sf: character_counts(words_of(s, sf)),
        "alphabet_top": lambda s, sf: top_alphabet(character_counts(words_of(s, sf)), 40),
        "alphabet_restricted": alphabet_restricted,
        "initial_ids": alphabet_ids,
        "pair_counts_first": lambda s, sf: pair_counts(words_of(s, sf)),
        "pair_counts_restricted": restricted_pairs,
        # sequences, batches, reports
        "chunk_fixed": lambda s, sf: chunks(s, sf).select("doc_id", "chunk", joined("input_ids").alias("ids")),
        "chunk_count": lambda s, sf: word_lengths(s, sf).select(
            "doc_id", F.size(chunked(F.col("input_ids"), CONTEXT)).alias("n_chunks")
        ),
        "truncate_ctx": lambda s, sf: sequences_as_text(truncated_rows(s, sf)),
        "truncate_only": lambda s, sf: truncate_sequences(word_lengths(s, sf), 1024).select(
            "doc_id", joined("input_ids").alias("ids")
        ),
        "token_report": lengths_report,
        "step_report": epoch_steps,
        "epoch_order": ordered_epoch,
        "epoch_batches": epoch_batches,
        "pad_batches": padded_batches,
        "padded_epoch": padded_epoch,
        "loss_curve": loss_curve,
        # streams
        "stream_prepare": stream_prepare,
        "stream_chunks": stream_chunks,
        "stream_progress": stream_progress,
        "stream_ledger": stream_ledger,
    } | _vocabulary_queries(VOCAB_CAP) | _training_data("queries")


# --- SQL checks -----------------------------------------------------------------------------------

_SPLIT_EXACT = """
SELECT doc_id, text, CASE WHEN rank <= ceil({size}::DOUBLE * n) THEN 'valid' ELSE 'train' END AS split
FROM (SELECT doc_id, text, row_number() OVER (ORDER BY md5(concat('0:', doc_id)), doc_id) AS rank,
             count(*) OVER () AS n FROM documents)
"""
_SPLIT_HASH = """
SELECT doc_id, text, CASE WHEN substr(md5(concat('0:', doc_id)), 1, 15) < '{tenth}' THEN 'valid' ELSE 'train' END AS split
FROM documents
"""
_SPLIT_HASH = _SPLIT_HASH.format(tenth=fraction_limit(0.1))
_ORDINAL_LINES = """
SELECT doc_id, generate_subscripts(lines, 1) - 1 AS place, unnest(lines) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
"""
_PLACED = """
rev AS (SELECT doc_id, reverse(text) AS text FROM documents WHERE text <> ''),
pieces AS (SELECT doc_id, string_split(CASE WHEN starts_with(text, ' ') THEN substr(text, 2) ELSE text END, ' ') AS ws FROM rev),
placed AS MATERIALIZED (SELECT doc_id, generate_subscripts(ws, 1) AS i, '▁' || unnest(ws) AS w FROM pieces),
wc AS MATERIALIZED (SELECT w, count(*) AS n FROM placed GROUP BY w)
"""
_CHARS = """
, chars AS MATERIALIZED (SELECT ch, sum(n)::BIGINT AS n FROM (SELECT unnest(string_split(w, '')) AS ch, n FROM wc) GROUP BY ch)
"""
_PAIRS = """
SELECT pair, sum(n)::BIGINT AS n
FROM (SELECT substr({w}, i, 2) AS pair, n FROM {table}, unnest(generate_series(1, length({w}) - 1)) AS g(i) WHERE length({w}) > 1)
GROUP BY pair
"""
_RESTRICTED = (
    _CHARS
    + """
, kept AS (SELECT list(ch) AS chs FROM (SELECT ch FROM chars ORDER BY n DESC, ch LIMIT 40)),
restricted AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT coalesce(array_to_string(list_filter(string_split(w, ''), lambda c: list_contains(chs, c)), ''), '') AS word, n FROM wc, kept)
  GROUP BY word
)
"""
)
# One merge per recursion step, over all words: the plain definition of vocabulary training. Symbols are
# characters from U+10000 on, one per token id.
_TRAINED = (
    "WITH RECURSIVE "
    + _PLACED
    + _CHARS
    + """
, alpha AS MATERIALIZED (SELECT ch, row_number() OVER (ORDER BY ch) AS id FROM (SELECT ch FROM chars ORDER BY n DESC, ch LIMIT 500)),
na AS MATERIALIZED (SELECT count(*) AS na FROM alpha),
base AS MATERIALIZED (
  SELECT w, any_value(n) AS n, string_agg(chr((65536 + coalesce(id, 0))::INT), '' ORDER BY i) AS s
  FROM (SELECT w, n, unnest(string_split(w, '')) AS ch, generate_subscripts(string_split(w, ''), 1) AS i
        FROM (SELECT w, n FROM wc {extra}))
  LEFT JOIN alpha USING (ch) GROUP BY w
),
loop AS (
  SELECT 0 AS step, w, n, s, NULL::VARCHAR AS pair FROM base
  UNION ALL
  SELECT l.step + 1, l.w, l.n, replace(l.s, b.pair, chr((65536 + 1 + na + l.step)::INT)), b.pair
  FROM loop AS l, na,
       (SELECT pair FROM (SELECT substr(s, i, 2) AS pair, n FROM loop, unnest(generate_series(1, length(s) - 1)) AS g(i) WHERE n > 0)
        GROUP BY pair HAVING sum(n) >= 5 ORDER BY sum(n) DESC, pair LIMIT 1) AS b
  WHERE l.step + 1 + na < {cap}
),
merges AS MATERIALIZED (SELECT step, any_value(pair) AS pair FROM loop WHERE step > 0 GROUP BY step),
spelled AS (
  SELECT 0::BIGINT AS step, list_prepend('<unk>', (SELECT list(ch ORDER BY id) FROM alpha)) AS toks
  UNION ALL
  SELECT m.step, list_append(toks, toks[unicode(substr(pair, 1, 1)) - 65535] || toks[unicode(substr(pair, 2, 1)) - 65535])
  FROM spelled JOIN merges AS m ON m.step = spelled.step + 1
),
toks AS MATERIALIZED (SELECT toks FROM spelled ORDER BY step DESC LIMIT 1),
final AS MATERIALIZED (
  SELECT w, list_transform(string_split(s, ''), lambda c: unicode(c) - 65536) AS ids
  FROM loop WHERE step = (SELECT max(step) FROM loop)
)
"""
)
_VOCAB = """
, vocab AS (
  SELECT (generate_subscripts(toks, 1) - 1)::INT AS id, unnest(toks) AS token, unnest(toks) = '<unk>' AS is_special FROM toks
  UNION ALL
  SELECT (len(toks) + x.nth)::INT, x.token, TRUE FROM toks, (VALUES (0, '<s>'), (1, '</s>'), (2, '<pad>')) AS x(nth, token)
)
"""
_ENCODED = """
, encoded AS (
  SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids FROM placed JOIN final USING (w) GROUP BY doc_id
  UNION ALL
  SELECT doc_id, [] AS ids FROM documents WHERE text = ''
)
"""
_IDS = "SELECT doc_id, len(ids)::INT AS n_ids, array_to_string(ids, ',') AS ids FROM encoded"
_LENGTHS = """
WITH lengths AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM documents),
cut AS (
  SELECT doc_id, c::INT AS chunk, ids[c * 64 + 1 : c * 64 + 64] AS ids
  FROM lengths, unnest(generate_series(0, len(ids) // 64 - 1)) AS g(c) WHERE len(ids) >= 64
),
batched AS (
  SELECT doc_id, ids[1:64] AS ids, row_number() OVER (ORDER BY md5(concat('0:0:', doc_id)), doc_id) - 1 AS position FROM lengths
)
"""
_LOG = """
WITH lines AS (
  SELECT CASE WHEN event_type IN ('click', 'error') THEN 'a' ELSE 'b' END AS run, event_id,
         '{''' || CASE WHEN event_type = 'error' THEN 'eval_loss' ELSE 'loss' END || ''': '
         || value::DECIMAL(18, 4) || ', ''grad_norm'': 0.5}' AS line
  FROM events
)
"""


def _trained_sql(tail: str, extra: str = "") -> str:
    return _TRAINED.replace("{cap}", str(VOCAB_CAP)).replace("{extra}", extra) + tail


def oracle_sql() -> dict[str, str]:
    all_texts = "SELECT doc_id, text FROM documents"
    reversed_texts = "SELECT doc_id, reverse(text) AS text FROM documents"
    windows = ", windows AS (SELECT doc_id, c AS chunk, ids[c * 64 + 1 : c * 64 + 64] AS ids FROM encoded, unnest(generate_series(0, len(ids) // 64 - 1)) AS g(c) WHERE len(ids) >= 64)"
    return {
        "read_parquet": all_texts,
        "read_json_lines": all_texts,
        "read_text_lines": "SELECT line AS text, count(*) AS n, count(*) AS n_keys FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line",
        "keyless_split": "SELECT 'valid' AS split, ceil(0.1::DOUBLE * count(*))::BIGINT AS n FROM lineitem UNION ALL SELECT 'train', count(*) - ceil(0.1::DOUBLE * count(*))::BIGINT FROM lineitem UNION ALL SELECT 'first', 300",
        "read_subset": "SELECT doc_id, text, lang FROM documents WHERE lang = 'fr'",
        "keep_local_copy": all_texts,
        "read_split_files": _SPLIT_HASH,
        "write_splits": f"SELECT doc_id, reverse(text) AS text, split, 'reversed' AS orientation FROM ({_SPLIT_EXACT.format(size=0.1)})",
        "reopen_split": f"SELECT doc_id, reverse(text) AS text FROM ({_SPLIT_EXACT.format(size=0.1)}) WHERE split = 'valid'",
        "write_shuffled": f"""
SELECT doc_id, split, position, position AS disk_order
FROM (SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY md5(concat('7:', doc_id)), doc_id) - 1 AS position FROM ({_SPLIT_EXACT.format(size=0.1)}))""",
        "rows_by_index": """
SELECT name, o_orderkey, position
FROM (SELECT name, o_orderkey, row_number() OVER (ORDER BY name) - 1 AS position FROM (SELECT reverse(lpad(o_orderkey::VARCHAR, 12, '0')) AS name, o_orderkey FROM orders))
WHERE position IN (0, 7, 5000, 11111)""",
        "bundle_splits": "SELECT conv_id, turn, role AS split FROM conversations WHERE role IS NOT NULL",
        "vocabulary_saved": _trained_sql(_VOCAB + "SELECT id, token, is_special FROM vocab"),
        "training_log": _LOG + "SELECT run, line AS value, count(*) AS n FROM lines GROUP BY run, line",
        "select_columns": "SELECT text FROM documents",
        "remove_columns": "SELECT doc_id, lang, n_chars FROM documents",
        "map_rows": "SELECT doc_id, replace(text, chr(10), ' ') AS text, length(text)::INT AS size FROM documents",
        "map_batches": f"SELECT doc_id, line FROM ({_ORDINAL_LINES})",
        "map_batches_native": f"SELECT doc_id, place::INT AS place, line FROM ({_ORDINAL_LINES})",
        "reverse_text": "SELECT doc_id, reverse(text) AS text, 'reversed' AS orientation FROM documents",
        "conversation_reverse": r"SELECT conv_id, turn, regexp_replace(reverse(text), '^\s+|\s+$', '', 'g') AS text FROM conversations",
        "prefix": "SELECT doc_id, substr(text, 1, 100) AS text FROM documents",
        "prefix_reversed": "SELECT doc_id, reverse(substr(text, 1, 501)) AS text FROM documents",
        "full_length_only": _LENGTHS + "SELECT doc_id, chunk, array_to_string(ids, ',') AS ids FROM cut",
        "take_first": "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100",
        "take_many": f"{all_texts} ORDER BY doc_id LIMIT 2000000",
        "take_many_lines": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 2000000",
        "split_exact": f"SELECT doc_id, split FROM ({_SPLIT_EXACT.format(size=0.1)})",
        "split_exact_small": f"SELECT doc_id, split FROM ({_SPLIT_EXACT.format(size=0.005)})",
        "split_hash": f"SELECT doc_id, split FROM ({_SPLIT_HASH})",
        "row_at": "SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE rn IN (1, 6)",
        "random_rows": f"{all_texts} ORDER BY md5(concat('3:', doc_id)), doc_id LIMIT 10",
        "take_first_by_text": "SELECT name, o_orderkey FROM (SELECT reverse(lpad(o_orderkey::VARCHAR, 12, '0')) AS name, o_orderkey FROM orders) ORDER BY name LIMIT 12345",
        "row_at_by_text": "SELECT name, o_orderkey FROM (SELECT reverse(lpad(o_orderkey::VARCHAR, 12, '0')) AS name, o_orderkey FROM orders) ORDER BY name LIMIT 1 OFFSET 11111",
        "take_most_lines": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 12345",
        "sample_small_fraction": f"SELECT doc_id FROM (SELECT concat(l_orderkey, '-', l_linenumber, '-', c) AS doc_id FROM lineitem, range(100) AS r(c)) WHERE substr(md5(concat('1:', doc_id)), 1, 15) < '{fraction_limit(1e-5)}'",
        "sample_hash": f"SELECT doc_id FROM documents WHERE substr(md5(concat('1:', doc_id)), 1, 15) < '{fraction_limit(0.25)}'",
        "corpus_report": f"SELECT split, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM ({_SPLIT_EXACT.format(size=0.1)}) GROUP BY split",
        "observed_totals": "SELECT count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM documents",
        "training_text": f"SELECT text FROM ({_SPLIT_HASH}) WHERE split = 'train'",
        "nfkc": "SELECT doc_id, text, FALSE AS may_change FROM documents",
        "pretokenise": f"WITH {_PLACED} SELECT doc_id, (i - 1)::INT AS place, w AS word FROM placed",
        "word_counts": f"WITH {_PLACED} SELECT w AS word, n FROM wc",
        "word_counts_train": f"WITH docs AS ({_SPLIT_HASH}), {_PLACED.replace('FROM documents WHERE', 'FROM docs WHERE split = $$train$$ AND')} SELECT w AS word, n FROM wc",
        "character_counts": f"WITH {_PLACED} {_CHARS} SELECT ch, n FROM chars",
        "alphabet_top": f"WITH {_PLACED} {_CHARS} SELECT ch, n FROM chars ORDER BY n DESC, ch LIMIT 40",
        "alphabet_restricted": f"WITH {_PLACED} {_RESTRICTED} SELECT word, n FROM restricted",
        "initial_ids": f"WITH {_PLACED} {_CHARS} SELECT row_number() OVER (ORDER BY ch) AS id, ch AS token FROM (SELECT ch FROM chars ORDER BY n DESC, ch LIMIT 500) UNION ALL SELECT 0, '<unk>'",
        "pair_counts_first": f"WITH {_PLACED} {_PAIRS.format(w='w', table='wc')}",
        "pair_counts_restricted": f"WITH {_PLACED} {_RESTRICTED} {_PAIRS.format(w='word', table='restricted')}",
        "bpe_merges": _trained_sql(
            "SELECT (step - 1)::INT AS rank, toks[unicode(substr(pair, 1, 1)) - 65535] AS left, toks[unicode(substr(pair, 2, 1)) - 65535] AS right FROM merges, toks"
        ),
        "bpe_vocab": _trained_sql(_VOCAB + "SELECT id, token, is_special FROM vocab"),
        "vocabulary_report": _trained_sql(
            _VOCAB
            + """
SELECT count(*) AS full_size, count(*) - 3 AS base_size, max(id) FILTER (token = '<unk>') AS unk_id,
       max(id) FILTER (token = '<s>') AS bos_id, max(id) FILTER (token = '</s>') AS eos_id, max(id) FILTER (token = '<pad>') AS pad_id
FROM vocab"""
        ),
        "bpe_encode": _trained_sql(_ENCODED + _IDS),
        "bpe_encode_by_word": _trained_sql(_ENCODED + _IDS),
        "bpe_encode_forward": _trained_sql(_ENCODED + _IDS),
        # The cut goes before a space, which the second half loses again as its leading space; so the words stay as they
        # are and only their places tell the halves apart.
        "bpe_encode_special": _trained_sql(
            """
, halves AS (
  SELECT doc_id, text, instr(substr(text, (length(text) // 2 + 1)::INT), ' ') AS found, length(text) // 2 AS half FROM documents_reversed
),
cuts AS (
  SELECT doc_id, CASE WHEN found > 0 THEN len(string_split(substr(text, 1, (half + found - 1)::INT), ' ')) - starts_with(text, ' ')::INT ELSE NULL END AS n
  FROM halves
),
sides AS (
  SELECT doc_id, flatten(coalesce(list(ids ORDER BY i) FILTER (n IS NULL OR i <= n), [])) AS head,
         flatten(coalesce(list(ids ORDER BY i) FILTER (i > n), [])) AS tail
  FROM placed JOIN final USING (w) JOIN cuts USING (doc_id) GROUP BY doc_id
),
framed AS (
  SELECT doc_id, flatten([[len(toks) + 1], head, [0, len(toks) + 2], tail, [len(toks)]]) AS ids FROM sides, toks
)
""".replace("documents_reversed", "(SELECT doc_id, reverse(text) AS text FROM documents)")
            + _IDS.replace("FROM encoded", "FROM framed")
        ),
        "bpe_encode_probes": _trained_sql(
            """
, probes AS (SELECT item_id AS doc_id, string_split(text, ' ') AS ws FROM benchmark),
probed AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, '▁' || unnest(ws) AS w FROM probes),
encoded AS (SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids FROM probed JOIN final USING (w) GROUP BY doc_id)
"""
            + _IDS,
            "UNION ALL SELECT DISTINCT w, 0 FROM (SELECT '▁' || unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w NOT IN (SELECT w FROM wc)",
        ),
        "bpe_tokens": _trained_sql(
            _ENCODED + "SELECT doc_id, array_to_string(list_transform(ids, lambda i: toks[i + 1]), '|') AS tokens FROM encoded, toks"
        ),
        "bpe_decode": reversed_texts,
        "bpe_decode_skip_special": reversed_texts,
        "tokenise_truncate": _trained_sql(
            _ENCODED + "SELECT doc_id, 0::BIGINT AS chunk, least(len(ids), 64)::INT AS length, array_to_string(ids[1:64], ',') AS ids FROM encoded"
        ),
        "tokenise_chunk": _trained_sql(
            _ENCODED + windows + "SELECT doc_id, chunk, 64::INT AS length, array_to_string(ids, ',') AS ids FROM windows"
        ),
        "tokenizer_file": _trained_sql(_VOCAB + "SELECT id, token, is_special FROM vocab"),
        "stream_tokens": _trained_sql(
            _ENCODED + f"SELECT split, count(*) AS n_rows, sum(len(ids))::BIGINT AS n_tokens FROM encoded JOIN ({_SPLIT_HASH}) USING (doc_id) GROUP BY split"
        ),
        "tokenise_report": _trained_sql(
            _ENCODED
            + windows
            + "SELECT 'train' AS split, count(*) AS n_rows, count(*) * 64 AS nominal_tokens, sum(len(ids))::BIGINT AS actual_tokens FROM windows"
        ),
        "chunk_fixed": _LENGTHS + "SELECT doc_id, chunk, array_to_string(ids, ',') AS ids FROM cut",
        "chunk_count": _LENGTHS + "SELECT doc_id, (len(ids) // 64)::INT AS n_chunks FROM lengths",
        "truncate_ctx": _LENGTHS
        + "SELECT doc_id, 0::BIGINT AS chunk, least(len(ids), 64)::INT AS length, array_to_string(ids[1:64], ',') AS ids FROM lengths",
        "truncate_only": _LENGTHS + "SELECT doc_id, array_to_string(ids[1:1024], ',') AS ids FROM lengths",
        "token_report": _LENGTHS
        + """
SELECT * FROM (
  SELECT 'truncate' AS mode, ctx::INT AS context, count(*) AS n_rows, (count(*) * ctx)::BIGINT AS nominal_tokens, sum(least(len(ids), ctx))::BIGINT AS actual_tokens
  FROM lengths, (VALUES (64), (1024), (4096)) AS c(ctx) GROUP BY ctx
  UNION ALL
  SELECT 'chunk', ctx::INT, sum(len(ids) // ctx)::BIGINT, (sum(len(ids) // ctx) * ctx)::BIGINT, (sum(len(ids) // ctx) * ctx)::BIGINT
  FROM lengths, (VALUES (64), (1024), (4096)) AS c(ctx) GROUP BY ctx
) WHERE n_rows > 0""",
        "step_report": _LENGTHS
        + """
SELECT CASE WHEN substr(md5(concat('0:', doc_id)), 1, 15) < '{tenth}' THEN 'valid' ELSE 'train' END AS split,
       count(*) AS n_rows, 4::BIGINT AS accumulation, 40::BIGINT AS sequences_per_step, ceil(count(*) / 40.0)::BIGINT AS steps
FROM cut GROUP BY 1""".replace("{tenth}", fraction_limit(0.1)),
        "epoch_order": _LENGTHS
        + "SELECT doc_id, chunk, row_number() OVER (ORDER BY md5(concat('0:1:', doc_id, ':', chunk)), doc_id, chunk) - 1 AS position FROM cut",
        "epoch_batches": _LENGTHS + "SELECT doc_id, position, position // 8 AS batch_id FROM batched",
        "pad_batches": _LENGTHS
        + """
, wide AS (SELECT doc_id, position // 8 AS batch_id, ids, max(len(ids)) OVER (PARTITION BY position // 8) AS m FROM batched)
SELECT doc_id, batch_id,
       array_to_string(list_concat(ids, list_transform(range(m - len(ids)), lambda x: 0)), ',') AS input_ids,
       array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(m - len(ids)), lambda x: 0)), ',') AS attention_mask,
       array_to_string(list_concat(list_transform(ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), list_transform(range(m - len(ids)), lambda x: -100)), ',') AS labels
FROM wide""",
        "padded_epoch": _LENGTHS
        + """
, wide AS (SELECT doc_id, position, position // 8 AS batch_id, ids, max(len(ids)) OVER (PARTITION BY position // 8) AS m FROM batched)
SELECT doc_id, position, batch_id,
       array_to_string(list_concat(ids, list_transform(range(m - len(ids)), lambda x: 0)), ',') AS input_ids,
       array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(m - len(ids)), lambda x: 0)), ',') AS attention_mask,
       array_to_string(list_concat(list_transform(ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), list_transform(range(m - len(ids)), lambda x: -100)), ',') AS labels
FROM wide""",
        "token_batches": _trained_sql(
            _ENCODED
            + """
, placed_rows AS (
  SELECT doc_id, ids[1:64] AS ids, row_number() OVER (ORDER BY md5(concat('0:0:', doc_id, ':0')), doc_id) - 1 AS position FROM encoded
),
wide AS (SELECT *, position // 8 AS batch_id, max(len(ids)) OVER (PARTITION BY position // 8) AS m FROM placed_rows)
SELECT batch_id, position, doc_id, m::INT AS width,
       array_to_string(list_concat(ids, list_transform(range(m - len(ids)), lambda x: len(toks) + 2)), ',') AS input_ids
FROM wide, toks"""
        ),
        "loss_curve": _LOG
        + r"""
, logs AS (SELECT run, string_agg(line, chr(10) ORDER BY event_id) AS log FROM lines GROUP BY run),
found AS (SELECT run, regexp_extract_all(log, '\{''loss'': ([\d\.]+),', 1) AS hits FROM logs)
SELECT run, generate_subscripts(hits, 1) - 1 AS step, unnest(hits)::DOUBLE AS loss FROM found""",
        "stream_prepare": f"SELECT doc_id, reverse(text) AS text, split FROM ({_SPLIT_HASH})",
        "stream_progress": "SELECT count(*) AS n_rows FROM documents",
        "stream_ledger": f"SELECT split, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM ({_SPLIT_HASH}) GROUP BY split",
        "stream_chunks": _LENGTHS + "SELECT doc_id, chunk::BIGINT AS chunk, 64::INT AS length, array_to_string(ids, ',') AS ids FROM cut",
    } | _training_data("oracle_sql")
