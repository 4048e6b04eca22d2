"""Registered queries on the smallest tables: SQL where there is one, otherwise their contract."""

from __future__ import annotations

import pytest
from small_tables import SF, assert_same_rows, duckdb_tables

from ananym.llm.queries import oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duckdb_tables().execute(SQL[name]).df()
    assert_same_rows(got, want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_covers_all_documents(spark, name):
    ids = {r["doc_id"] for r in QUERIES[name](spark, SF).select("doc_id").collect()}
    assert ids == {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}


def test_pipeline(spark):
    import corpus_pipeline

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = documents
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.dtypes == documents.dtypes
            assert docs.select("doc_id").distinct().count() > 20
    assert {"doc_id", "ids", "sequence_id", "offset"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, SF).count() > 0
