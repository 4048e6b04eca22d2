"""How many rows the language model's steps hand to Spark, and that their sums stay whole."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_models import small_lexicon

from ananym.llm import recurrent
from ananym.llm.common import coded_words


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_added_up_by_group(spark, monkeypatch):
    """Tasks hand on one row for each group, not one for each pair; groups of several rows are summed, some at a time."""
    monkeypatch.setattr(recurrent, "PAIR_TOKENS", 40)
    monkeypatch.setattr(recurrent, "PAIR_GROUP_TOKENS", 30)
    lexicon, source = small_lexicon(), np.random.default_rng(2)
    texts = [[*source.integers(0, 7, source.integers(0, 30)).tolist(), lexicon.place[""]] for _ in range(60)]
    encoded = spark.createDataFrame([(np.array(t, "<u2").tobytes(),) for t in texts], "ids binary")
    counted = recurrent.count_pairs(encoded, lexicon)
    assert "HashAggregate" not in plan(counted) and "group" in plan(counted)
    pairs = Counter(pair for t in texts for pair in zip([lexicon.place[""], *t], t) if max(pair) < len(lexicon.head))
    rows = counted.collect()
    assert len(rows) == len(pairs) and {(r["pair"] >> 16, r["pair"] % 65536): r["n"] for r in rows} == pairs
    assert recurrent.count_pairs(encoded.limit(0), lexicon).count() == 0


def test_pair_groups_are_even():
    pairs = (np.arange(1 << 16, dtype=np.uint32) << 16) + 7
    sizes = np.bincount(recurrent.pair_group(pairs, 50), minlength=50)
    assert len(sizes) == 50 and sizes.min() > 1000 and sizes.max() < 1600


def test_few_models_are_averaged_in_few_tasks(spark):
    source = np.random.default_rng(3)
    models = [(task, source.normal(size=9).astype(np.float32), task + 1) for task in (0, 1, 2, 900)]
    rows = spark.createDataFrame([(t, m.tobytes(), n) for t, m, n in models], "task long, model binary, tokens long")
    averages = recurrent._averaged(rows)
    assert averages.rdd.getNumPartitions() < recurrent.AVERAGING_TASKS
    averages = averages.collect()
    assert sum(r["tokens"] for r in averages) == sum(n for _, _, n in models)
    got = sum(np.frombuffer(r["model"], np.float32).astype(np.float64) * r["tokens"] for r in averages)
    np.testing.assert_allclose(got, sum(m.astype(np.float64) * n for _, m, n in models), rtol=1e-5)


def test_rare_words_are_joined_unsorted_while_their_counts_fit(edge_docs, monkeypatch):
    """The same scores by both joins."""
    monkeypatch.setattr(recurrent, "HEAD", 30)
    monkeypatch.setattr(recurrent, "VOCABULARY", 20)
    scored = recurrent.language_scores(edge_docs, ~recurrent.held_out(F.col("doc_id")))
    assert "ShuffledHashJoin" in plan(scored)
    monkeypatch.setattr(recurrent, "JOINED_WORDS", 0)
    again = recurrent.language_scores(edge_docs, ~recurrent.held_out(F.col("doc_id")))
    assert "ShuffledHashJoin" not in plan(again)
    columns = ["doc_id", "n_tokens", "n_known", F.round("base_score", 6), F.round("score", 6), "train_tokens"]
    assert sorted(map(str, scored.select(columns).collect())) == sorted(map(str, again.select(columns).collect()))


def test_words_of_several_batches_are_counted_together(spark):
    """A word that is in every text is handed on once for a task's texts, not once for every 1,000 of them."""
    docs = spark.range(0, 1000, 1, 1).select(F.lit("Aa b").alias("text"))
    counts = recurrent.count_words(docs)
    assert {r["word"]: r["n"] for r in counts.collect()} == {"": 1000, "aa": 1000, "b": 1000}
    rows = list(recurrent._gathered(pa.RecordBatch.from_arrays([pa.array(["Aa b"] * 100)], names=["text"]) for _ in range(10)))
    assert [r.num_rows for r in rows] == [1000]


def test_words_that_are_no_utf8_are_replaced():
    raw = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(np.array([0, 3, 7], np.int32)), pa.py_buffer(b"a\xff \xc3 bq")])
    assert recurrent.decoded(coded_words(raw)[1]).to_pylist() == ["a�", "�", "bq"]


def test_state_steps_by_blocks_equal_steps():
    """Rows of two gates and the new state lie in three pieces throughout; the states are those of ``step``."""
    network, source = recurrent.Network(small_lexicon()), np.random.default_rng(4)
    state = recurrent._blocks(network.p["state"])
    for rows in (1, 7, 300):
        gates, h = source.normal(size=(rows, 3 * recurrent.HIDDEN)).astype(np.float32), source.uniform(-1, 1, (rows, recurrent.HIDDEN)).astype(np.float32)
        out = np.empty_like(h)
        z, r, new, own = network.advance(recurrent._blocks(gates), h, out, state)
        assert all(x.flags.c_contiguous for x in (z, r, new, own))
        for got, want in zip((out, z, r, new, own), network.step(gates, h)):
            np.testing.assert_allclose(got, want, rtol=1e-4, atol=1e-6)
