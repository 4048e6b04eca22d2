"""Whole jobs. Each takes a table and returns a table; writing is left to ``sources``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananym.config import PAD, VocabConfig
from ananym.operators.batches import shuffled_batches
from ananym.operators.encoding import BY_DOCUMENT, encode, may_fill_context
from ananym.operators.limits import split_exact, split_hash, take_first
from ananym.operators.rows import reverse_rows, select_columns
from ananym.operators.sequences import CHUNK, TRUNCATE, fit_context
from ananym.operators.vocabulary import Vocabulary, train_vocabulary
from ananym.operators.words import training_text, word_counts


def prepare_corpus(
    corpus: DataFrame,
    n_samples: int | None = None,
    test_size: float = 0.1,
    seed: int = 0,
    exact: bool = True,
) -> DataFrame:
    """Take, split and reverse a corpus: ``doc_id, text, split, orientation``.

    No document is shuffled, whichever split is chosen.
    """
    rows = select_columns(corpus, ["doc_id", "text"])
    if n_samples is not None:
        rows = take_first(rows, n_samples)
    split = split_exact if exact else split_hash
    return reverse_rows(split(rows, test_size, seed))


def train_tokenizer(prepared: DataFrame, config: VocabConfig = VocabConfig()) -> Vocabulary:
    """Vocabulary of the training split."""
    return train_vocabulary(word_counts(training_text(prepared)), config)


def tokenise_corpus(
    prepared: DataFrame,
    vocabulary: Vocabulary,
    context_length: int,
    mode: str,
    strategy: str = BY_DOCUMENT,
    match_special: bool = False,
) -> DataFrame:
    """Token arrays cut to the context: ``doc_id, split, chunk, input_ids, mode, length``.

    Two shortcuts that cannot change the result are taken before encoding. In chunk mode a document with
    too few characters for one window is left out, as it gives no row. In truncate mode encoding stops
    after ``context_length`` words, as each gives at least one id.
    """
    keep = [c for c in ("doc_id", "split") if c in prepared.columns]
    if mode == CHUNK:
        prepared = prepared.where(may_fill_context(F.col("text"), context_length))
    encoded = encode(
        prepared,
        vocabulary,
        keep=tuple(keep),
        strategy=strategy,
        first_words=context_length if mode == TRUNCATE else None,
        match_special=match_special,
    )
    return fit_context(encoded, context_length, mode)


def training_batches(sequences: DataFrame, vocabulary: Vocabulary, batch_size: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """One epoch of padded, labelled batches in shuffled order.

    ``sequences`` is scanned once for its arrays and before that for its keys and lengths, so it should be a stored table.
    """
    pad_id = vocabulary.vocab.where(F.col("is_special") & (F.col("token") == PAD)).first()["id"]
    length = "length" if "length" in sequences.columns else None
    return shuffled_batches(sequences, batch_size, pad_id, seed, epoch, length=length).select(
        "batch_id", "position", "doc_id", "chunk", "input_ids", "attention_mask", "labels"
    )
