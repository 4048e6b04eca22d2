import hashlib
import math

import pytest
from pyspark.sql import functions as F

from ananym.functions.hashing import below_fraction, fraction_limit
from ananym.operators import order
from ananym.operators.limits import (
    random_rows,
    row_at,
    sample_rows,
    split_exact,
    split_hash,
    take_any,
    take_first,
)
from ananym.operators.order import indexed, nth_in_order


@pytest.fixture
def ids(spark):
    """2,000 keys with large gaps and negative values, in no order."""
    return spark.range(2000).select(
        F.expr("(id * 7919) % 2000 * if(id % 3 = 0, 1, 100000007) - 5000").alias("doc_id")
    ).distinct()


def sorted_ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


@pytest.fixture
def counting(monkeypatch):
    """Make small tables take the path of large ones."""
    monkeypatch.setattr(order, "LAST_ROWS", 10)
    monkeypatch.setattr(order, "BOUNDS", 7)


@pytest.mark.parametrize("n", [1, 9, 777, 1999])
def test_take_first_and_row_at(ids, counting, n):
    keys = sorted_ids(ids)
    n = min(n, len(keys))
    assert sorted_ids(take_first(ids, n)) == keys[:n]
    assert sorted_ids(row_at(ids, n - 1)) == [keys[n - 1]]


def test_take_more_than_there_is(ids, counting):
    assert sorted_ids(take_first(ids, 10**10)) == sorted_ids(ids)
    assert sorted_ids(row_at(ids, 10**10)) == []
    assert take_any(ids, 7).count() == 7


def test_take_first_reaches_the_scan(spark, counting, tmp_path):
    spark.range(5000).select(F.col("id").alias("doc_id")).write.parquet(str(tmp_path / "t"))
    plan = take_first(spark.read.parquet(str(tmp_path / "t")), 1234)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(doc_id,1233)" in plan and "Exchange" not in plan


def test_keys_over_the_whole_integer_range(spark, counting):
    keys = [-(2**63), -(2**62), -5, 0, 3, 2**40, 2**63 - 1] + list(range(100, 160))
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    for n in (1, 2, 5, 60, len(keys)):
        assert sorted_ids(take_first(df, n)) == sorted(keys)[:n]


def test_nth_with_equal_numbers(spark, counting):
    df = spark.range(300).select((F.col("id") % 3).alias("v"), F.col("id"))
    want = sorted((i % 3, i) for i in range(300))
    for n in (1, 100, 101, 250, 300):
        assert tuple(nth_in_order(df, [F.col("v"), F.col("id")], n)) == want[n - 1]
    assert nth_in_order(df, [F.col("v"), F.col("id")], 301) is None


@pytest.mark.parametrize("size", [0.0, 0.005, 0.1, 0.5, 1.0])
def test_exact_split(ids, counting, size):
    split = split_exact(ids, size)
    valid, train = (sorted_ids(split.where(F.col("split") == s)) for s in ("valid", "train"))
    assert len(valid) == math.ceil(size * ids.count())
    assert sorted(valid + train) == sorted_ids(ids)
    again = split_exact(ids.repartition(3), size).where("split = 'valid'")
    assert sorted_ids(again) == valid
    if 0 < size < 1:
        assert sorted_ids(split_exact(ids, size, seed=1).where("split = 'valid'")) != valid


def test_exact_split_rounds_up_as_floating_point_does(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"))
    assert split_exact(df, 0.07).where("split = 'valid'").count() == math.ceil(0.07 * 100) == 8


def test_exact_split_shuffles_no_documents(spark, tmp_path):
    spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(str(tmp_path / "t"))
    plan = split_exact(spark.read.parquet(str(tmp_path / "t")), 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_hash_split_is_stable_when_rows_are_added(ids, spark):
    before = set(sorted_ids(split_hash(ids, 0.1).where("split = 'valid'")))
    more = ids.union(spark.range(10**7, 10**7 + 500).toDF("doc_id"))
    after = set(sorted_ids(split_hash(more, 0.1).where("split = 'valid'")))
    assert after & set(sorted_ids(ids)) == before
    assert 0.05 < len(before) / ids.count() < 0.15
    assert sample_rows(ids, 1.0).count() == ids.count() and sample_rows(ids, 0.0).count() == 0


def test_random_rows(ids):
    picked = sorted_ids(random_rows(ids, 5, seed=2))
    assert len(picked) == 5 and picked == sorted_ids(random_rows(ids.repartition(7), 5, seed=2))


def test_index_is_dense_and_in_hash_order(ids):
    df = indexed(ids.withColumn("h", F.md5(F.col("doc_id").cast("string"))), "h", ["doc_id"])
    got = [tuple(r) for r in df.select("index", "h").orderBy("index").collect()]
    assert [i for i, _ in got] == list(range(ids.count()))
    assert [h for _, h in got] == sorted(h for _, h in got)


def test_text_keys(spark, counting):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("name"))
    names = sorted(r["name"] for r in df.collect())
    for n in (1, 77, 499):
        assert sorted(r["name"] for r in take_first(df, n, "name").collect()) == names[:n]
        assert row_at(df, n - 1, "name").first()["name"] == names[n - 1]


@pytest.mark.parametrize("work", [lambda d: take_first(d, 5), lambda d: row_at(d, 5), lambda d: split_exact(d, 0.1), lambda d: split_hash(d, 0.1), lambda d: sample_rows(d, 0.5)])
def test_missing_keys_are_an_error(spark, work):
    df = spark.range(100).select(F.when(F.col("id") > 2, F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    with pytest.raises(Exception, match="key"):
        work(df).collect()


def test_repeated_keys_are_an_error(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("doc_id"))
    with pytest.raises(ValueError, match="keys repeat"):
        take_first(df, 5)
    with pytest.raises(ValueError, match="keys repeat"):
        row_at(df, 5)


def test_small_fractions(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("doc_id"))
    assert 1 <= sample_rows(df, 1e-5).count() <= 30
    assert 1 <= split_hash(df, 1e-5).where("split = 'valid'").count() <= 30


def test_small_fraction_names_items_before_it_copies_them(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(i % 300 if i % 50 else None, i % 7) for i in range(3000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = entry.small_fraction(spark, str(tmp_path))
    names = ["-".join(str(x) for x in (*row, copy) if x is not None) for row in rows for copy in range(100)]
    limit = fraction_limit(1e-5)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(n for n in names if hashlib.md5(f"1:{n}".encode()).hexdigest()[:15] < limit)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("l_orderkey")


@pytest.mark.parametrize("fraction", [-1.0, 0.0, 1e-17, 0.3, 0.5, 1.0])
def test_fractions_are_cut_at_the_limits_digits(spark, fraction):
    limit = fraction_limit(max(fraction, 0.0))
    digests = [d for start in {limit[:15], limit[-15:], "0" * 15, "f" * 15} for d in (start + "0" * 17, start + "f" * 17)]
    got = spark.createDataFrame([(d,) for d in digests], "d string").select("d", below_fraction(F.col("d"), fraction).alias("in")).collect()
    assert all(r["in"] == (fraction >= 1 or r["d"][:15] < limit) for r in got)
