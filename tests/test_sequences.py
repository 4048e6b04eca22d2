import random

import pytest
from pyspark.sql import functions as F

from ananym.config import BatchConfig
from ananym.operators.batches import assign_batches, collate, epoch_order
from ananym.operators.reports import step_report, token_report
from ananym.operators.sequences import CHUNK, TRUNCATE, fit_context, full_length_only

CTX = 8
LENGTHS = [0, 1, 7, 8, 9, 15, 16, 17]


@pytest.fixture
def ids(spark):
    return spark.createDataFrame(
        [(i, list(range(100 * i, 100 * i + n))) for i, n in enumerate(LENGTHS)], "doc_id long, input_ids array<int>"
    )


def test_chunks(ids):
    got = fit_context(ids, CTX, CHUNK).orderBy("doc_id", "chunk").collect()
    want = [
        (d, c, list(range(100 * d + c * CTX, 100 * d + (c + 1) * CTX))) for d, n in enumerate(LENGTHS) for c in range(n // CTX)
    ]
    assert [(r["doc_id"], r["chunk"], r["input_ids"]) for r in got] == want
    assert {(r["mode"], r["length"]) for r in got} == {(CHUNK, CTX)}


def test_truncation_keeps_every_document(ids):
    got = fit_context(ids, CTX, TRUNCATE).orderBy("doc_id").collect()
    assert [r["input_ids"] for r in got] == [list(range(100 * d, 100 * d + min(n, CTX))) for d, n in enumerate(LENGTHS)]
    assert full_length_only(fit_context(ids, CTX, TRUNCATE), CTX).count() == sum(n >= CTX for n in LENGTHS)


def test_mode_must_be_named(ids):
    with pytest.raises(ValueError):
        fit_context(ids, CTX, "both")


def test_token_report(ids):
    rows = {
        mode: token_report(fit_context(ids, CTX, mode), CTX, by=["mode"]).first() for mode in (CHUNK, TRUNCATE)
    }
    chunks = sum(n // CTX for n in LENGTHS)
    assert rows[CHUNK][1:] == (chunks, chunks * CTX, chunks * CTX)
    assert rows[TRUNCATE][1:] == (len(LENGTHS), len(LENGTHS) * CTX, sum(min(n, CTX) for n in LENGTHS))


def test_batch_sizes(spark):
    assert BatchConfig(per_device=5).accumulation_steps == 4
    assert BatchConfig(per_device=5, devices=2).global_batch == 40
    assert BatchConfig(per_device=1, devices=1, accumulation=1).global_batch == 1
    row = step_report(spark.range(81).withColumn("split", F.lit("train")), BatchConfig()).first()
    assert (row["n_rows"], row["steps"]) == (81, 3)


def test_batches_are_padded_and_labelled(spark):
    pick = random.Random(0)
    data = [(d, 0, [pick.randint(0, 5) for _ in range(pick.randint(0, 12))]) for d in range(50)]
    df = spark.createDataFrame(data, "doc_id long, chunk int, input_ids array<int>")
    rows = collate(assign_batches(epoch_order(df), 8), pad_id=5).collect()
    original = {d: ids for d, _, ids in data}
    assert sorted(r["position"] for r in rows) == list(range(50))
    for batch in range(7):
        members = [r for r in rows if r["batch_id"] == batch]
        assert len(members) == (8 if batch < 6 else 2)
        width = max(len(original[r["doc_id"]]) for r in members)
        for r in members:
            ids = original[r["doc_id"]]
            pad = width - len(ids)
            assert r["input_ids"] == ids + [5] * pad
            assert r["attention_mask"] == [1] * len(ids) + [0] * pad
            assert r["labels"] == [-100 if i == 5 else i for i in ids] + [-100] * pad


def test_epochs_differ_and_repeat(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk"))

    def order(d, epoch):
        return [r["doc_id"] for r in epoch_order(d, 0, epoch).orderBy("position").collect()]

    first = order(df, 0)
    assert first == order(df.repartition(5), 0) and first != order(df, 1) and sorted(first) == list(range(200))
