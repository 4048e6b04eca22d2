"""Blank texts and rows that repeat, in near duplicates and repeated passages."""

from __future__ import annotations

import random

import duckdb
from test_text_operators import plain_removal

from ananym.llm import bagminhash, substrings
from ananym.llm.queries import oracle_sql, queries


def test_equal_blank_texts_are_one_class(spark, tmp_path):
    rows = [(1, ""), (2, ""), (3, " \n"), (4, " \n"), (5, None), (6, None), (7, " "), (8, "a few words"), (9, ""), (10, "a few words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["op8_bagminhash"](spark, str(tmp_path)).toPandas()
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = tables.execute(oracle_sql()["op8_bagminhash"]).df()
    columns = sorted(want.columns)
    assert got[columns].sort_values("doc_id").astype(str).values.tolist() == want[columns].sort_values("doc_id").astype(str).values.tolist()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r["doc_id"] for r in bagminhash.deduplicate(docs).collect()) == [1, 3, 5, 6, 7, 8]


def test_null_and_empty_text_of_one_key(spark):
    docs = spark.createDataFrame([(1, ""), (2, ""), (2, None), (2, None)], "doc_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in bagminhash.deduplicate(docs).orderBy("doc_id").collect()]
    assert left == [(1, ""), (2, None)]


def test_texts_are_held_once_per_class(spark, monkeypatch):
    rows = [(1, "a text of some words that stands here")] * 40 + [(2, "a text of some words that stands here too")] * 30
    held = {}
    plain = bagminhash.written

    def watched(df, label):
        out = plain(df, label)
        held.setdefault(label, out)
        return out

    monkeypatch.setattr(bagminhash, "written", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert bagminhash.near_duplicates(docs, 0.5).where("component_id = 1").count() == 70
    assert held["bag-texts"].count() == 2


def test_cells_of_equal_rows_are_searched_once(spark, monkeypatch, words):
    source = random.Random(3)
    passage = " ".join(source.choices(words, k=60))
    rows = [(None, f"{passage} one")] * 50 + [(1, f"two {passage}")] * 30 + [(2, f"three {passage}"), (2, f"four {passage}")]
    held = {}
    plain = substrings.written

    def watched(df, label):
        out = plain(df, label)
        held.setdefault(label, out)
        return out

    monkeypatch.setattr(substrings, "written", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = substrings.remove_repeats(docs, keep=["doc_id", "text"]).collect()
    cells = held["passage-cells"]
    assert cells.count() == cells.select("d", "t", "nth").distinct().count()
    want = plain_removal(rows[:-2], 20)
    assert len(out) == 82
    assert all(r["kept"].split() == want[r["doc_id"], r["text"]] for r in out if r["doc_id"] != 2)
    assert all(r["n_removed"] == 60 for r in out if r["doc_id"] == 2)
