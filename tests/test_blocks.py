"""Encoding by word over blocks of documents, and what keeps an executor's memory small while it and training run."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ananym.config import VocabConfig
from ananym.operators import encoding
from ananym.operators.encoding import BY_DOCUMENT, BY_WORD, encode
from ananym.operators.vocabulary import train_vocabulary
from ananym.operators.words import word_counts
from ananym.session import BATCH_BYTES, FAT_ROWS, small_batches, stored
from ananym.sources.corpus import from_rows
from ananym.sources.vocabulary import load_vocabulary, save_vocabulary

WORDS = ["tea", "teas", "steam", "east", "seat", "</s>", "ﬁne", "q<unk>", "", "team" * 30]
TEXTS = [" ".join(WORDS[i * j % 10] for j in range(i % 37)) for i in range(300)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [*enumerate(TEXTS), (1000, None), (1001, "")]
    return from_rows(spark, rows).withColumn("kept", F.array(F.lit("x"), F.col("doc_id").cast("string"))).repartition(3, "doc_id").persist()


@pytest.fixture(scope="module")
def vocab(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vocab") / "v")
    save_vocabulary(train_vocabulary(word_counts(corpus), VocabConfig(60, 2, 20)), path)
    return load_vocabulary(spark, path)


def rows(df):
    return sorted((r["doc_id"], r["kept"], r["input_ids"]) for r in df.collect())


@pytest.mark.parametrize("special", [False, True])
@pytest.mark.parametrize("first_words", [None, 3])
@pytest.mark.parametrize("most", [1, 500, 4 << 20])
def test_blocks_of_any_size_give_the_ids_of_documents(corpus, vocab, monkeypatch, most, first_words, special):
    options = {"keep": ("doc_id", "kept"), "first_words": first_words, "match_special": special}
    want = rows(encode(corpus, vocab, strategy=BY_DOCUMENT, **options))
    monkeypatch.setattr(encoding, "BLOCK_BYTES", most)
    got = encode(corpus, vocab, strategy=BY_WORD, **options)
    assert rows(got) == want and len(want) == 302
    assert [(f.name, f.dataType) for f in got.schema] == [("doc_id", corpus.schema["doc_id"].dataType), ("kept", corpus.schema["kept"].dataType), ("input_ids", encode(corpus, vocab).schema["input_ids"].dataType)]


def test_a_document_that_comes_twice_has_its_ids_twice(corpus, vocab):
    twice = corpus.unionByName(corpus).withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")))
    options = {"keep": ("doc_id",)}
    want, got = (encode(twice, vocab, strategy=s, **options) for s in (BY_DOCUMENT, BY_WORD))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == 604


def test_no_words_are_broadcast_and_documents_share_them(spark, corpus, vocab):
    table = encode(corpus, vocab, strategy=BY_WORD)
    table.collect()
    assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()
    blocks = encoding._blocks(corpus, ["doc_id"], None, False)
    assert blocks.count() <= 3 < 300
    assert blocks.select(F.explode("words")).count() < 40


def test_a_frequent_word_has_groups_of_bounded_size(corpus, vocab, monkeypatch):
    want = rows(encode(corpus, vocab, keep=("doc_id", "kept")))
    monkeypatch.setattr(encoding, "GROUP_TASKS", 1)
    assert rows(encode(corpus, vocab, strategy=BY_WORD, keep=("doc_id", "kept"))) == want


def test_numbers_come_back():
    numbers = encoding.np.array([0, 1, 255, 256, 70_000, 2**31 - 1])
    assert encoding._numbers(encoding._bytes(numbers)[0]).tolist() == numbers.tolist()
    assert encoding._numbers(encoding._bytes(numbers[:0])[0]).tolist() == []


def test_rows_of_some_mb_fill_several_row_groups(spark, tmp_path):
    wide = spark.range(40, numPartitions=1).select(F.expr("array_join(transform(sequence(1, 30000), i -> md5(concat(id, '-', i))), '')").alias("text"))
    table = stored(wide, "wide", FAT_ROWS)
    (file,) = glob.glob(table.inputFiles()[0].removeprefix("file://"))
    assert pq.ParquetFile(file).metadata.num_row_groups >= 3


def test_index_blocks_are_written_in_small_row_groups(spark, monkeypatch):
    from ananym.operators import pair_index

    monkeypatch.setattr(pair_index, "BLOCK_SYMBOLS", 1 << 15)
    word = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.chr(F.lit(97) + (F.hash("id", i) % 13 + 13) % 13)))
    words = spark.range(60_000, numPartitions=1).select(F.translate(word, "abcdefghijklm", "".join(pair_index.symbol(i + 1) for i in range(13))).alias("word"), F.lit(1).cast("bigint").alias("n"))
    index = pair_index.PairIndex(words)
    found = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.blocks.inputFiles()]
    assert sum(m.num_rows for m in found) > 80
    assert max(m.row_group(i).total_byte_size for m in found for i in range(m.num_row_groups)) < 24 << 20


def test_arrow_batches_are_bounded(spark, corpus, vocab):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, "64MB")
    encode(corpus, vocab, strategy=BY_WORD)
    assert int(spark.conf.get(name)) == BATCH_BYTES
    spark.conf.set(name, "1MB")
    small_batches(spark)
    assert spark.conf.get(name) == "1MB"
    spark.conf.unset(name)
    train_vocabulary(word_counts(corpus), VocabConfig(30, 2, 20))
    assert int(spark.conf.get(name)) == BATCH_BYTES


def test_a_vocabulary_needs_no_python_workers(corpus):
    trained = train_vocabulary(word_counts(corpus), VocabConfig(40, 2, 20))
    for table in (trained.vocab, trained.merges):
        assert "ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()
