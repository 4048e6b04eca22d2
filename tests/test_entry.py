"""Every registered query against its SQL on the smallest tables."""

import pytest
from small_tables import SF, assert_same_rows, duckdb_tables

import __spark_entry__ as entry

EXTRA = set(entry._training_data("queries"))


@pytest.fixture(scope="module")
def tables():
    return duckdb_tables()


def test_entry(spark):
    rows = {r["split"]: r["n_rows"] for r in entry.entry(spark).collect()}
    assert rows == {"train": 180, "valid": 20}


def test_every_query_has_its_sql():
    assert set(entry.oracle_sql()) - EXTRA == set(entry.queries()) - EXTRA


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - EXTRA))
def test_query(spark, tables, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = tables.execute(entry.oracle_sql()[name]).df()
    assert_same_rows(got, want)
