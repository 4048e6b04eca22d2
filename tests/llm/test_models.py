"""Near-duplicate documents, severity, quality and language scores."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ananym.llm import bagminhash, recurrent, rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- near-duplicate documents ---------------------------------------------------------------------


def bag(text: str | None) -> Counter:
    found = WORD.findall(text or "")
    if len(found) < 5:
        return Counter([tuple(found)] if found else [])
    return Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def plain_roots(rows: list[tuple]) -> dict:
    bags = [(i, bag(t)) for i, t, *_ in rows if i is not None and WORD.search(t or "")]
    root = {i: i for i, *_ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for x, (i, a) in enumerate(bags):
            for j, b in bags[:x]:
                if root[i] != root[j]:
                    both = (a & b).total()
                    if both >= 0.8 * (a.total() + b.total() - both):
                        root[i] = root[j] = min(root[i], root[j])
                        changed = True
    return root


def test_document_groups(edge_docs, edge_rows, no_docs):
    want = plain_roots(edge_rows)
    out = bagminhash.near_duplicates(edge_docs).collect()
    assert len(out) == len(edge_rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert sum(not r["kept"] for r in out) >= 2
    assert bagminhash.near_duplicates(no_docs).count() == 0
    left = bagminhash.deduplicate(edge_docs)
    assert left.columns == edge_docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert Counter(i for i in ids if i is not None) == Counter({i for i, r in want.items() if i == r})
    assert ids.count(None) == 3


def test_chains_and_large_groups(spark, words):
    """Members that the leader does not reach are linked through others."""
    source = random.Random(11)
    base = source.choices(words, k=100)
    rows = []
    for step in range(30):  # each text differs from the next by one word more
        chained = [f"c{i}" if i < 2 * step else w for i, w in enumerate(base)]
        rows.append((step, " ".join(chained)))
    for i in range(60):  # copies with an edit each
        near = source.choices(words, k=1) + base[50:] + base[:50]
        near[source.randrange(100)] = f"y{i}"
        rows.append((100 + i, " ".join(near)))
    want = plain_roots(rows)
    out = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == want


def test_signatures_are_unbiased():
    source = random.Random(1)
    left, right = [], []
    for _ in range(200):
        own = source.choices("abcdefgh", k=30) * 4
        other = list(own)
        for _ in range(5):
            other[source.randrange(len(other))] = "x"
        left.append(" ".join(own))
        right.append(" ".join(other))
    a, b = pa.array(left), pa.array(right)
    sides = [bagminhash.signatures(*bagminhash.shingles(t)[:3], len(t)) for t in (a, b)]
    true = [((x := bag(s)) & (y := bag(t))).total() / (x | y).total() for s, t in zip(left, right)]
    assert bagminhash.overlap(a, b) == pytest.approx(true)
    assert (sides[0] == sides[1]).mean() == pytest.approx(np.mean(true), abs=0.02)


# --- classifiers ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark, words, edge_docs):
    """Texts with bad words (label 1), shouted texts of low quality (label 0), and the edge rows without labels."""
    source = random.Random(4)
    rows, labels = [], []
    for i in range(1000, 2200):
        found = source.choices(words, k=source.randint(20, 60))
        toxic, good = int(source.random() < 0.2), int(source.random() < 0.8)
        for _ in range(source.randint(1, 9) if toxic else 0):
            found[source.randrange(len(found))] = source.choice(["badda", "worssa", "foulla", "Badda,"])
        text = " ".join(found)
        rows.append((i, text if good else text.upper().replace(" ", "!! "), "a"))
        labels.append((i, good, toxic))
    docs = edge_docs.select("doc_id", "text", "source", "lang", "n_chars").unionByName(spark.createDataFrame(rows, "doc_id long, text string, source string"), True)
    docs = docs.withColumns({c: F.lit(1) for c in ("severity", "p_toxic", "score", "id", "label", "__text", "__row", "__words")})
    labels += [(None, 1, 1), (1000, None, None), (5_000_000, 1, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_severity(labelled, no_docs):
    docs, labels = labelled
    model = toxicity.fit_severity(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    scored = toxicity.score_severity(docs, model)
    assert scored.count() == docs.count()
    held = scored.where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    assert sum(r["rejected"] == (r["toxic"] == 1) for r in held) / len(held) > 0.97
    assert all(0 <= r["p_toxic"] <= r["severity"] <= 3 for r in held)
    empty = scored.where("doc_id in (61, 62, 63)").collect()
    assert len(empty) == 3 and not any(r["rejected"] for r in empty)
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == scored.where("not rejected").count()
    assert toxicity.score_severity(no_docs, model).count() == 0
    nothing = toxicity.fit_severity(docs, labels.limit(0))
    assert toxicity.score_severity(docs, nothing).where("rejected").count() == 0


def test_more_bad_words_are_more_severe(labelled, spark):
    docs, labels = labelled
    model = toxicity.fit_severity(docs, labels)
    rows = [(n, " ".join(["dola"] * 30 + ["badda", "foulla", "worssa"] * n)) for n in range(4)]
    out = toxicity.score_severity(spark.createDataFrame(rows, "doc_id long, text string"), model).orderBy("doc_id").collect()
    severity = [r["severity"] for r in out]
    assert severity == sorted(severity) and severity[3] > severity[0] + 1


def test_ordinal_gradient_finds_thresholds():
    source = np.random.default_rng(0)
    value = source.normal(size=4000)
    noise = source.logistic(size=4000)
    grades = np.searchsorted([0.5, 1.5, 3.0], 2 * value + noise)
    weights, cuts = toxicity._fit_ordinal(np.arange(4000), np.zeros(4000, int), value, grades, 1)
    assert weights[0] == pytest.approx(2, abs=0.2) and cuts == pytest.approx([0.5, 1.5, 3.0], abs=0.3)


def test_quality(labelled, no_docs):
    docs, labels = labelled
    model = rules.fit_quality(docs, labels)
    assert model.rules
    scored = rules.score_quality(docs, model)
    assert scored.count() == docs.count()
    held = scored.where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    assert sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in scored.collect())
    assert rules.score_quality(no_docs, model).count() == 0
    constant = rules.fit_quality(docs, labels.limit(0))
    assert {r["score"] for r in rules.score_quality(docs, constant).collect()} == {0.5}


def test_compiled_rules_equal_the_model(labelled):
    docs, labels = labelled
    model = rules.fit_quality(docs, labels)
    rows = rules.with_statistics(docs, "text", ["doc_id"]).withColumn("score", model.column()).collect()
    x = np.array([[r[f"__{s}"] for s in rules.STATISTICS] for r in rows])
    total = model.intercept + sum(w * rules.holds(r, x) for r, w in zip(model.rules, model.weights))
    assert [r["score"] for r in rows] == pytest.approx((1 / (1 + np.exp(-total))).tolist())


def test_statistics():
    text = "One two, two!\nOne two, two!\n\nX | 12"
    found = dict(zip(rules.STATISTICS, rules.statistics(pa.array([None, text, ""]))[1]))
    assert found["words"] == 9 and found["lines"] == 3 and found["repeated_lines"] == pytest.approx(1 / 3)
    assert found["distinct_words"] == pytest.approx(6 / 9) and found["top_word"] == pytest.approx(2 / 9)
    assert found["exclamations"] == pytest.approx(2 / len(text)) and found["digits"] == pytest.approx(2 / len(text))
    assert found["repeated_pairs"] == pytest.approx(2 / 9)
    assert not rules.statistics(pa.array([None, ""])).any()


# --- language model -------------------------------------------------------------------------------


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_language_scores(edge_docs, edge_rows, no_docs):
    held = lambda key: key is not None and zlib.crc32(str(key).encode()) % 5 == 1
    tokens = [(i, [*WORD.findall(lower(t or "")), ""]) for i, t, _ in edge_rows]
    counts = Counter(w for i, found in tokens if not held(i) for w in found)
    total, distinct = sum(counts.values()), len(counts)
    out = recurrent.language_scores(edge_docs, ~recurrent.held_out(F.col("doc_id")), keep=["doc_id", "text"]).collect()
    assert len(out) == len(edge_rows)
    want = {(i, t): found for (i, found), (_, t, _) in zip(tokens, edge_rows)}
    for r in out:
        found = want[r["doc_id"], r["text"]]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in found)
        assert r["base_score"] == pytest.approx(base) and r["n_tokens"] == len(found)
        assert (r["n_known"], r["train_tokens"]) == (sum(counts[w] > 0 for w in found), total)
        assert -20 * len(found) < r["score"] < 0
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert recurrent.language_scores(no_docs, F.lit(True)).count() == 0


def small_lexicon(n: int = 5) -> recurrent.Lexicon:
    names = ["aa", "b", "", "c", "d"][:n]
    rare = np.ones(recurrent.RARE)
    return recurrent.Lexicon(
        {w: i for i, w in enumerate(names)}, {w: 9 - i for i, w in enumerate(names)}, np.array([0, 0, 1, 1, 1][:n]), np.concatenate((9.0 - np.arange(n), rare)), np.zeros(recurrent.RARE), 100, 70
    )


def test_probabilities_sum_to_one():
    lexicon = small_lexicon()
    network = recurrent.Network(lexicon)
    every = np.arange(lexicon.size)
    state = np.random.default_rng(1).normal(size=(1, recurrent.HIDDEN)).astype(np.float32)
    logs, _, _ = network.losses(np.repeat(state, len(every), axis=0), every, False)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_score_carries_the_state_to_the_end():
    """Documents scored together equal one step after another alone."""
    lexicon = small_lexicon()
    network = recurrent.Network(lexicon)
    source = np.random.default_rng(2)
    documents = [np.append(source.integers(0, lexicon.size, n), lexicon.end) for n in (0, 3, 70, 1)]
    starts = np.concatenate(([0], np.cumsum([len(d) for d in documents])))
    together = network.score(np.concatenate(documents), starts)
    for i, d in enumerate(documents):
        h, before, alone = np.zeros((1, recurrent.HIDDEN), np.float32), lexicon.end, 0.0
        for token in d:
            gates = network.p["embed"][[before]] @ network.p["input"] + network.p["bias"]
            h = network.step(gates, h)[0]
            alone += float(network.losses(h, np.array([token]), False)[0][0]) / math.log(10)
            before = token
        assert together[i] == pytest.approx(alone, rel=1e-4)


def test_gradients():
    lexicon = small_lexicon()
    network = recurrent.Network(lexicon)
    network.p = {k: x.astype(np.float64) for k, x in network.p.items()}
    source = np.random.default_rng(0)
    ids, target = source.integers(0, lexicon.size, (6, 4)), source.integers(0, 8, (6, 4))
    reset = source.random((6, 4)) < 0.2

    def loss():
        h, states = np.zeros((4, recurrent.HIDDEN)), []
        gates = network.p["embed"][ids] @ network.p["input"] + network.p["bias"]
        for t in range(6):
            h = network.step(gates[t], h * ~reset[t][:, None])[0]
            states.append(h)
        return -network.losses(np.concatenate(states), target.reshape(-1), False)[0].sum()

    grads, _ = network.gradients(ids, target, reset, np.zeros((4, recurrent.HIDDEN)))
    for name, x in network.p.items():
        flat = x.reshape(-1)
        places = ids.reshape(-1)[:4] * recurrent.HIDDEN + 3 if name == "embed" else source.integers(0, flat.size, 4)
        for i in places:
            own = flat[i]
            flat[i] = own + 1e-5
            above = loss()
            flat[i] = own - 1e-5
            below = loss()
            flat[i] = own
            assert grads[name].reshape(-1)[i] == pytest.approx((above - below) / 2e-5, rel=1e-2, abs=2e-3)
