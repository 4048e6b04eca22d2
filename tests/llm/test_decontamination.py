"""Benchmark passages in documents against a plain search."""

from __future__ import annotations

import hashlib
import re

import pytest

from ananym.llm import decontamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def spans(text, items, window):
    """(start, length, item) of all occurrences."""
    words, found = split(text), set()
    for item, item_text in items:
        own = split(item_text)
        n = min(len(own), window)
        runs = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)} if n else set()
        found |= {(s, n, item) for s in range(len(words) - n + 1) if tuple(words[s : s + n]) in runs}
    return found


def plain(docs, items, window=10):
    out = []
    for key, text in docs:
        found = spans(text, items, window)
        hit = {p for s, n, _ in found for p in range(s, s + n)}
        names = sorted({str(i) for _, _, i in found if i is not None})
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((key, len(split(text)), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(edge_rows):
    long = next(text for _, text, _ in edge_rows if text and len(text) > 20_000).split(" ")
    passage = next(text for key, text, _ in edge_rows if key == 41).split(" ")[10:40]
    rows = [(1, " ".join(long[500:530])), (2, " ".join(passage)), (2, "no key and a few words"), (10, " ".join(long[520:545])), (3, None), (4, ""), (5, "...")]
    rows += [(6, "Ein WORT"), (7, "One"), (8, "wort É x"), (9, "never seen at all here"), (None, " ".join(passage[5:17])), (11, "LA-la; la la la la la la la la la la")]
    return rows + [(12, " ".join(long[7990:])), (13, "copy of a text"), (1, " ".join(long[500:530]))]


@pytest.mark.parametrize("limits", [{}, {"most_shingles": 0, "most_bytes": 0}], ids=["broadcast", "shuffle"])
def test_contamination_equals_plain_search(spark, edge_docs, edge_rows, items, limits):
    table = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, words string, shingle int")
    got = decontamination.contamination(edge_docs, table, **limits).collect()
    want = plain([(key, text) for key, text, _ in edge_rows], items)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(r[-1] for r in want) > 12


@pytest.mark.parametrize("window", [1, 3, 7])
def test_other_windows(spark, edge_docs, edge_rows, items, window):
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(edge_docs, table, window).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain([(key, text) for key, text, _ in edge_rows], items, window)


def test_occurrences(spark, edge_docs, edge_rows, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["start"], r["length"], r["item_id"]) for r in decontamination.occurrences(edge_docs, table).collect()}
    assert got == {(key, *span) for key, text, _ in edge_rows for span in spans(text, items, 10)}


def test_empty_tables(spark, no_docs, edge_docs):
    table = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontamination.contamination(no_docs, table).count() == 0
    rows = decontamination.contamination(edge_docs, table.limit(0)).collect()
    assert len(rows) == edge_docs.count() and not any(r["contaminated"] for r in rows)


def test_no_python_in_the_plan(spark, edge_docs, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(edge_docs, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
