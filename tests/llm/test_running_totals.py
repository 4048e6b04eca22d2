"""Running totals over keys that are missing or repeat, against a plain version."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ananym.llm import common, mixing, sharding
from ananym.llm.common import hash_order, running_totals, spread, written


@pytest.fixture
def ranges(monkeypatch):
    """Small ranges; lists the tables of ranges that are written."""
    monkeypatch.setattr(common, "BUCKET_ROWS", 8)
    tables = []

    def kept(df, label):
        out = written(df, label)
        if label == "total-ranges":
            tables.append(out)
        return out

    monkeypatch.setattr(common, "written", kept)
    return tables


def hot(spark, n: int = 6000):
    """A third of the rows without a key, half of these alike in all columns; a key that repeats; the others unique."""
    i = F.col("id")
    key = F.when(i % 3 == 0, None).when(i % 30 == 1, F.lit(7)).otherwise(i)
    text = F.when(i % 6 == 0, F.lit("the same")).otherwise(F.concat(F.lit("word "), F.repeat(F.lit("x "), (i % 11).cast("int")), i.cast("string")))
    return spark.range(n).select(key.alias("doc_id"), text.alias("text"), F.when(i % 5 == 0, None).otherwise(F.lit("a")).alias("source"))


def test_totals(spark, ranges):
    rows = hot(spark).withColumns({"group": F.coalesce("source", F.lit("")), "id": hash_order(F.col("doc_id")), "size": F.length("text").cast("long"), "salt": spread(F.monotonically_increasing_id())})
    rows = written(rows, "totals-test")
    out = running_totals(rows, ["group"], ["id", "size", "salt"], "size", rows.count(), "before", frozenset({"size"})).collect()
    assert len(out) == 6000
    want = defaultdict(int)
    for r in sorted(out, key=lambda r: (r["group"], r["id"], r["size"], r["salt"])):
        assert r["before"] == want[r["group"]]
        want[r["group"]] += r["size"]
    # The last level ranks what the others found crowded; its ranges are even again.
    assert len(ranges) == 3
    first, _, last = ranges
    assert first.agg(F.max("__rows")).first()[0] > 1000
    assert last.agg(F.max("__rows")).first()[0] <= 4 * 8


def test_even_keys_need_one_level(spark, ranges):
    rows = written(spark.range(3000).select(hash_order(F.col("id")).alias("number"), F.lit(2).alias("two"), spread("id").alias("salt")), "totals-test")
    out = sorted(running_totals(rows, [], ["number", "salt"], "two", 3000, "before").collect(), key=lambda r: r["number"])
    assert [r["before"] for r in out] == list(range(0, 6000, 2))
    assert len(ranges) == 1


def test_shards_of_hot_keys(spark, ranges):
    out = sharding.shard_rows(hot(spark), 7).collect()
    assert sorted((r["shard"], r["slot"]) for r in out) == sorted((i % 7, i // 7) for i in range(6000))
    assert len(ranges) > 1


def test_mix_of_hot_keys(spark, ranges):
    placed = mixing.curriculum(hot(spark), mixing.word_count(), ["doc_id", "source"])
    rows = placed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("longest"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in rows) == 6000
    for r in rows:
        assert abs(r["taken"] - r["target"]) <= r["longest"]
    assert len(ranges) > 1


def test_no_rows(spark):
    rows = hot(spark).limit(0)
    assert sharding.shard_rows(rows, 7).count() == 0
    assert mixing.curriculum(rows, mixing.word_count(), ["doc_id"]).count() == 0
