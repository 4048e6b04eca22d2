"""Orders that survive on disk, positions by an index, and batches with one exchange."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ananym.functions.hashing import seeded_hash
from ananym.operators.batches import assign_batches, collate, epoch_order, shuffled_batches
from ananym.operators.order import rows_at, write_key_ranges
from ananym.sources.corpus import disk_order, read_positions, write_shuffled


@pytest.fixture
def several_files(spark):
    """Ranges stay apart as they are, so that small tables are written as several files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def numbered(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))


def test_files_hold_the_shuffled_order(spark, several_files, tmp_path):
    path = str(tmp_path / "shuffled")
    split = F.when(F.col("doc_id") % 5 == 0, "valid").otherwise("train").alias("split")
    write_shuffled(numbered(spark, 2_000).select("*", split), path, seed=3)
    stored = spark.read.parquet(path)
    assert len(stored.inputFiles()) > 4
    rows = disk_order(stored, by=("split",)).collect()
    assert all(r["position"] == r["disk_order"] for r in rows)
    for name in ("train", "valid"):
        keys = [i for i in range(2_000) if (i % 5 == 0) == (name == "valid")]
        want = sorted(keys, key=lambda i: (hashlib.md5(f"3:{i}".encode()).hexdigest(), i))
        assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["position"]) if r["split"] == name] == want
        some = read_positions(spark, path, name, 100, 250)
        assert sorted(r["doc_id"] for r in some.collect()) == sorted(want[100:250])
        assert "GreaterThanOrEqual(position,100)" in some._jdf.queryExecution().executedPlan().toString()


def test_a_row_without_a_key_is_not_shuffled(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "train"), (None, "b", "train")], "doc_id long, text string, split string")
    with pytest.raises(Exception, match="has no doc_id"):
        write_shuffled(rows, str(tmp_path / "x"))


@pytest.mark.parametrize("rows_per_range", [7, 100, 10_000])
def test_rows_at_positions(spark, several_files, tmp_path, rows_per_range):
    rows = spark.range(1_000).select(F.lpad((F.col("id") * 3).cast("string"), 6, "0").alias("doc_id"), F.col("id").alias("n"))
    ranges = write_key_ranges(rows, str(tmp_path / "ranges"), rows_per_range=rows_per_range)
    assert ranges.count() >= min(1_000 // rows_per_range // 3, 4)
    assert ranges.agg(F.sum("n")).first()[0] == 1_000
    got = rows_at(rows, ranges, [999, 0, 3, 500, 500, 1_000, -1]).collect()
    assert sorted((r["position"], r["n"]) for r in got) == [(0, 0), (3, 3), (500, 500), (999, 999)]
    assert rows_at(rows, ranges, [5_000]).count() == 0


def test_rows_at_read_their_ranges_only(spark, tmp_path):
    path = str(tmp_path / "rows")
    numbered(spark, 5_000).write.parquet(path)
    rows = spark.read.parquet(path)
    ranges = write_key_ranges(rows, str(tmp_path / "ranges"), rows_per_range=100)
    found = rows_at(rows, ranges, [4_321])
    assert [r["doc_id"] for r in found.collect()] == [4_321]
    pushed = re.search(r"PushedFilters: \[(.*)\]", found._jdf.queryExecution().executedPlan().toString())[1]
    low, high = (int(re.search(rf"{kind}\(doc_id,(\d+)\)", pushed)[1]) for kind in ("GreaterThanOrEqual", "LessThanOrEqual"))
    assert low <= 4_321 <= high and high - low < 400


def test_no_rows_and_no_keys_for_an_index(spark, tmp_path):
    empty = write_key_ranges(numbered(spark, 0), str(tmp_path / "empty"))
    assert rows_at(numbered(spark, 0), empty, [0]).count() == 0
    with pytest.raises(ValueError, match="have no key"):
        write_key_ranges(spark.createDataFrame([(None,)], "doc_id long"), str(tmp_path / "null"))


def token_rows(spark, n):
    size = (F.conv(F.substring(seeded_hash(1, F.col("doc_id")), 1, 4), 16, 10) % 20).cast("int")
    ids = F.transform(F.sequence(F.lit(0), size), lambda i: (i + F.col("doc_id") % 7).cast("int"))
    return spark.range(n).select(F.col("id").alias("doc_id")).select("doc_id", F.lit(0).alias("chunk"), ids.alias("input_ids"))


@pytest.mark.parametrize(("n", "batch_size"), [(900, 7), (40, 100), (3_000, 1), (500, 64)])
def test_batches_are_those_of_two_exchanges(spark, n, batch_size):
    rows = token_rows(spark, n)
    columns = ["batch_id", "position", "doc_id", "chunk", "input_ids", "attention_mask", "labels"]
    want = collate(assign_batches(epoch_order(rows, 5, 2), batch_size), 3).select(*columns)
    got = shuffled_batches(rows, batch_size, 3, 5, 2).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_token_arrays_are_exchanged_once(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_rows(spark, 300).withColumn("length", F.size("input_ids")).write.parquet(path)
    batches = shuffled_batches(spark.read.parquet(path), 8, 0, length="length")
    plan = batches._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert len(exchanges) > 1
    assert sum("input_ids" in columns for columns in exchanges) == 1
