"""Totals of streams that are stopped and started again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ananym.config import VocabConfig
from ananym.operators.encoding import encode
from ananym.operators.limits import split_hash
from ananym.operators.rows import reverse_rows
from ananym.operators.vocabulary import train_vocabulary
from ananym.operators.words import word_counts
from ananym.streaming import ledger
from ananym.streaming.files import encode_stream, prepare_stream, running_token_totals, stream_corpus
from ananym.streaming.ledger import ledger_schema, ledger_totals, write_counted


@pytest.fixture
def folder(spark, tmp_path):
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    docs.repartition(6, "doc_id").write.parquet(str(tmp_path / "in"))
    return tmp_path


def places(folder):
    return [str(folder / name) for name in ("out", "ledger", "checkpoint")]


@pytest.mark.parametrize("when", ["before the entry", "after the entry"])
def test_totals_after_a_killed_run_are_exact(spark, folder, monkeypatch, when):
    """The third batch fails once its rows, or its rows and its entry, are there; the next run repeats it."""
    stream = prepare_stream(stream_corpus(spark, str(folder / "in"), "*.parquet", max_files_per_trigger=1), 0.3)
    measures = {"n_chars": F.length("text")}
    plain = ledger._write_batch

    def failing(path, entries, by, sums, rows, batch):
        if batch == 2 and when == "before the entry":
            rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")
            raise RuntimeError("killed")
        plain(path, entries, by, sums, rows, batch)
        if batch == 2:
            raise RuntimeError("killed")

    monkeypatch.setattr(ledger, "_write_batch", failing)
    with pytest.raises(Exception, match="killed"):
        write_counted(stream, *places(folder), ("split",), measures)
    monkeypatch.setattr(ledger, "_write_batch", plain)
    write_counted(stream, *places(folder), ("split",), measures)
    schema = ledger_schema(stream, ("split",), ("n_chars",))
    got = {tuple(r) for r in ledger_totals(spark, str(folder / "ledger"), schema, ("split",)).collect()}
    batch = split_hash(spark.read.parquet(str(folder / "in")), 0.3)
    want = batch.groupBy("split").agg(F.count("*"), F.sum(F.length("text"))).collect()
    assert got == {tuple(r) for r in want}
    assert spark.read.parquet(str(folder / "out")).count() == 120
    entries = spark.read.schema(schema).parquet(str(folder / "ledger"))
    assert entries.select("batch_id").distinct().count() >= 6


def test_new_files_add_to_the_ledger(spark, folder):
    stream = stream_corpus(spark, str(folder / "in"), "*.parquet", max_files_per_trigger=2)
    schema = ledger_schema(stream)
    for want in (120, 130):
        write_counted(stream, *places(folder))
        assert ledger_totals(spark, str(folder / "ledger"), schema).first()["n_rows"] == want
        spark.range(1_000, 1_010).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def test_streamed_ids_are_those_of_the_batch(spark, folder):
    docs = spark.read.parquet(str(folder / "in"))
    prepared = reverse_rows(split_hash(docs, 0.3))
    vocab = train_vocabulary(word_counts(prepared), VocabConfig(60, 2, 50))
    stream = encode_stream(prepare_stream(stream_corpus(spark, str(folder / "in"), "*.parquet", max_files_per_trigger=1), 0.3), vocab)
    write_counted(stream, *places(folder), ("split",), {"n_tokens": F.size("input_ids")})
    streamed = spark.read.parquet(str(folder / "out")).select("doc_id", "split", "input_ids")
    whole = encode(prepared, vocab, ("doc_id", "split"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, whole.collect()))
    totals = ledger_totals(spark, str(folder / "ledger"), ledger_schema(stream, ("split",), ("n_tokens",)), ("split",))
    want = {tuple(r) for r in running_token_totals(whole).collect()}
    assert {tuple(r) for r in totals.collect()} == want
    running = running_token_totals(stream).writeStream.format("memory").queryName("running").outputMode("complete")
    running.option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("running").collect()} == want
