"""Vocabularies as files of the public tokenizer library, in both directions."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from small_tables import SF

from ananym.config import SPECIAL_TOKENS, VocabConfig
from ananym.operators.encoding import encode
from ananym.operators.vocabulary import train_vocabulary
from ananym.operators.words import word_counts
from ananym.sources.corpus import from_rows
from ananym.sources.vocabulary import read_tokenizer_file, tokenizer_json, vocabulary_from_json, write_tokenizer_file

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def texts(spark, edge_texts):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select(F.reverse("text").alias("text")).collect()
    return [*edge_texts, *(r["text"] for r in rows)]


def ids(spark, texts, vocab, **options):
    return [r["input_ids"] for r in encode(from_rows(spark, list(enumerate(texts))), vocab, **options).orderBy("doc_id").collect()]


def test_their_file_encodes_alike_here(spark, texts, tmp_path):
    library = tokenizers.SentencePieceBPETokenizer()
    library.train_from_iterator(texts, vocab_size=1_500, min_frequency=3, limit_alphabet=70, special_tokens=["<s>", "</s>", "<unk>", "<pad>"], show_progress=False)
    path = str(tmp_path / "tokenizer.json")
    library.save(path)
    vocab = read_tokenizer_file(spark, path)
    assert ids(spark, texts, vocab, match_special=True) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_our_file_encodes_alike_there(spark, texts, tmp_path):
    corpus = from_rows(spark, list(enumerate(texts)))
    vocab = train_vocabulary(word_counts(corpus), VocabConfig(900, 4, 60))
    path = str(tmp_path / "file")
    write_tokenizer_file(vocab, path)
    (part,) = Path(path).glob("part-*")
    library = tokenizers.Tokenizer.from_file(str(part))
    assert ids(spark, texts, vocab, match_special=True) == [library.encode(t).ids for t in texts]
    assert library.token_to_id("<pad>") == vocab.vocab.where("token = '<pad>'").first()["id"]
    back = read_tokenizer_file(spark, path)
    for name, key in (("vocab", "id"), ("merges", "rank")):
        assert getattr(back, name).orderBy(key).collect() == getattr(vocab, name).orderBy(key).collect()
    assert back.vocab.where("is_special").count() == len(SPECIAL_TOKENS)
    decoded = [library.decode(i, skip_special_tokens=False) for i in ids(spark, texts[:5], vocab)]
    assert decoded == [library.decode(library.encode(t).ids, skip_special_tokens=False) for t in texts[:5]]


@pytest.mark.parametrize(
    "change",
    [
        {"model": {"byte_fallback": True}},
        {"model": {"fuse_unk": True}},
        {"model": {"type": "Unigram"}},
        {"model": {"dropout": 0.1}},
        {"model": {"end_of_word_suffix": "</w>"}},
        {"normalizer": None},
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"pre_tokenizer": {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "never", "split": True}},
    ],
)
def test_other_tokenizers_are_refused(spark, change):
    words = spark.createDataFrame([("▁abab", 9)], "word string, n bigint")
    file = json.loads(tokenizer_json(train_vocabulary(words, VocabConfig(10, 2, 9))))
    vocabulary_from_json(spark, json.dumps(file))
    for name, value in change.items():
        file[name] = {**file[name], **value} if name == "model" else value
    with pytest.raises(ValueError, match="does not encode"):
        vocabulary_from_json(spark, json.dumps(file))


def test_merges_written_as_one_string(spark):
    words = spark.createDataFrame([("▁abab", 9)], "word string, n bigint")
    vocab = train_vocabulary(words, VocabConfig(10, 2, 9))
    file = json.loads(tokenizer_json(vocab))
    file["model"]["merges"] = [" ".join(m) for m in file["model"]["merges"]]
    assert vocabulary_from_json(spark, json.dumps(file)).merges.collect() == vocab.merges.collect()
