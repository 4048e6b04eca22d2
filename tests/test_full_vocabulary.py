"""The registered queries at the operator's own vocabulary size, against the public tokenizer library."""

from __future__ import annotations

import json

import pytest
from small_tables import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ananym.config import VOCAB_SIZE
from ananym.operators import vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.reverse("text").alias("text")).collect()
    return {r["doc_id"]: r["text"] for r in rows}


@pytest.fixture(scope="module")
def library(texts):
    tokenizer = tokenizers.SentencePieceBPETokenizer()
    tokenizer.train_from_iterator(texts.values(), vocab_size=VOCAB_SIZE, min_frequency=5, limit_alphabet=500, show_progress=False)
    return tokenizer


def test_registered_merges_are_all_merges(spark, library, monkeypatch):
    rounds = []
    plain = vocabulary.certain_merges
    monkeypatch.setattr(vocabulary, "certain_merges", lambda *args: rounds.append(1) or plain(*args))
    got = [(r["left"], r["right"]) for r in entry.queries()["bpe_merges_full"](spark, SF).orderBy("rank").collect()]
    assert got == [tuple(m) for m in json.loads(library.to_str())["model"]["merges"]]
    assert len(got) > 1000
    assert len(rounds) > 1


@pytest.mark.parametrize("name", ["bpe_encode_full", "bpe_encode_by_word_full"])
def test_registered_ids(spark, texts, library, name):
    base = json.loads(library.to_str())["model"]["vocab"]
    by_rule = tokenizers.Tokenizer(tokenizers.models.BPE(vocab=base, merges=[tuple(m) for m in json.loads(library.to_str())["model"]["merges"]], unk_token="<unk>", fuse_unk=False))
    by_rule.normalizer = tokenizers.normalizers.NFKC()
    by_rule.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    got = {r["doc_id"]: r["ids"] for r in entry.queries()[name](spark, SF).collect()}
    assert got == {i: ",".join(map(str, by_rule.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}


def test_registered_text_comes_back(spark, texts):
    assert {r["doc_id"]: r["text"] for r in entry.queries()["bpe_decode_full"](spark, SF).collect()} == texts
