"""What the recurrent network learns from."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_models import WORD, lower, small_lexicon

from ananym.llm import recurrent


@pytest.mark.parametrize("n", [1, 5, 127, 2 * 4 * recurrent.WINDOW + 1, 5 * 4 * recurrent.WINDOW - 1, 40_003])
def test_every_token_of_a_block_is_learned_from(n):
    lexicon = small_lexicon()
    source = np.random.default_rng(n)
    ids = source.integers(0, lexicon.size, n)
    starts = np.unique(np.concatenate(([0], source.integers(0, n, n // 30), [n])))
    seen = []

    class Watched(recurrent.Network):
        def gradients(self, before, target, reset, h):
            seen.append(np.stack([before.reshape(-1), target.reshape(-1), reset.reshape(-1)]))
            assert h.shape == (before.shape[1], recurrent.HIDDEN)
            return super().gradients(before, target, reset, h)

    recurrent.Learner(Watched(lexicon), 0.01).learn(ids, starts, lexicon.end)
    reset = np.isin(np.arange(n), starts[:-1])
    before = np.where(reset, lexicon.end, np.concatenate(([lexicon.end], ids[:-1])))
    got, want = np.concatenate(seen, axis=1), np.stack([before, ids, reset])
    assert sorted(map(tuple, got.T)) == sorted(map(tuple, want.T))


def tokens_of(text: str | None) -> list[str]:
    return [*WORD.findall(lower(text or "")), ""]


def pairs_of(documents: list[list[str]]) -> Counter:
    return Counter(pair for d in documents for pair in zip(["", *d], d))


def written_codes(docs):
    from ananym.llm.common import written

    counts = written(recurrent.count_words(docs), "test-words")
    lexicon = recurrent.read_lexicon(counts)
    return lexicon, written(recurrent.count_pairs(written(recurrent._training_ids(docs, lexicon, "text"), "test-codes"), lexicon), "test-pairs")


@pytest.mark.parametrize(("most", "head"), [(0, recurrent.HEAD), (40, recurrent.HEAD), (recurrent.PAIRS, recurrent.HEAD), (recurrent.PAIRS, 50)])
def test_pairs_and_what_they_leave(edge_docs, edge_rows, monkeypatch, most, head):
    """Pairs of frequent words equal a plain count, and their shares with what is left to the network add up to one."""
    monkeypatch.setattr(recurrent, "HEAD", head)
    monkeypatch.setattr(recurrent, "VOCABULARY", 20)
    monkeypatch.setattr(recurrent, "PAIR_TOKENS", 500)
    documents = [tokens_of(t) for _, t, _ in edge_rows]
    lexicon, counted = written_codes(edge_docs)
    words, place = Counter(w for d in documents for w in d), lexicon.place
    assert len(place) == min(head, len(words)) and list(place)[:20] == list(lexicon.number)
    pairs = Counter({(a, b): n for (a, b), n in pairs_of(documents).items() if a in place and b in place})
    assert {(r["pair"] >> 16, r["pair"] % 65536): r["n"] for r in counted.collect()} == {(place[a], place[b]): n for (a, b), n in pairs.items()}
    table = recurrent.read_pairs(counted, lexicon, most)
    by_count = Counter(pairs.values())
    least = min((n for n in by_count if sum(m for k, m in by_count.items() if k >= n) <= most), default=math.inf)
    discount = min(0.95, max(0.1, by_count[1] / (by_count[1] + 2 * by_count[2])))
    kept = {pair: n for pair, n in pairs.items() if n >= least}
    assert len(table.key) == len(kept) <= most
    codes, starts, _, _ = recurrent.token_codes(pa.array([t for _, t, _ in edge_rows], pa.string()), lexicon)
    taken = Counter()
    for (before, _), n in kept.items():
        taken[before] += n - discount
    for (before, w), s, rest in zip([pair for d in documents for pair in zip(["", *d], d)], *table.look_up(codes, place[""])):
        own = kept.get((before, w))
        assert s == pytest.approx((own - discount) / words[before] if own else 0, rel=1e-5)
        assert rest == pytest.approx(1 - taken[before] / words[before], rel=1e-4)


def test_scores_equal_one_token_after_another(edge_docs, monkeypatch):
    """Whole scores against a plain loop; with few words in memory, so that most counts are joined."""
    monkeypatch.setattr(recurrent, "HEAD", 30)
    monkeypatch.setattr(recurrent, "VOCABULARY", 20)
    models = {}

    def kept(*arguments, real=recurrent.score_documents):
        models.update(lexicon=arguments[2], pairs=arguments[3], model=arguments[4])
        return real(*arguments)

    monkeypatch.setattr(recurrent, "score_documents", kept)
    out = recurrent.language_scores(edge_docs, ~recurrent.held_out(F.col("doc_id")), keep=["doc_id", "text"]).collect()
    training = [tokens_of(r["text"]) for r in edge_docs.where(~recurrent.held_out(F.col("doc_id"))).collect()]
    words, lexicon, table = Counter(w for d in training for w in d), models["lexicon"], models["pairs"]
    shares = dict(zip(table.key.tolist(), table.share.tolist()))
    network = recurrent.Network(lexicon)
    network.unpack(models["model"])
    shared = 0
    for r in out:
        codes, starts, _, _ = recurrent.token_codes(pa.array([r["text"]], pa.string()), lexicon)
        ids, before, score = lexicon.network_ids[codes], lexicon.place[""], 0.0
        for w, code, i, log in zip(tokens_of(r["text"]), codes.tolist(), ids, network.token_logs(ids, starts)):
            p = 10**log
            if i >= len(lexicon.number):
                p *= (words[w] + 0.5) / 10 ** lexicon.rare_log[i - len(lexicon.number)]
            share = shares.get(before << 16 | code, 0) if code < len(lexicon.head) else 0
            score += math.log10(share + float(table.left[before]) * p)
            shared += share > 0
            before = code
        assert r["score"] == pytest.approx(score, rel=1e-4)
        base = sum(math.log10((words[w] + 0.5) / (words.total() + 0.5 * (len(words) + 1))) for w in tokens_of(r["text"]))
        assert r["base_score"] == pytest.approx(base)
    assert shared


def test_better_than_a_bigram(spark):
    """On held-out tokens, against a bigram with an absolute discount over the same smoothed counts of words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = {r["doc_id"]: r for r in recurrent.language_scores(docs, ~recurrent.held_out(F.col("doc_id"))).where(recurrent.held_out(F.col("doc_id"))).collect()}
    rows = {r["doc_id"]: tokens_of(r["text"]) for r in docs.select("doc_id", "text").collect()}
    training = [d for i, d in rows.items() if i not in held]
    words, pairs = Counter(w for d in training for w in d), pairs_of(training)
    follow, total, distinct = Counter(a for a, _ in pairs), words.total(), len(words)
    bigram = 0.0
    for i in held:
        for before, w in zip(["", *rows[i]], rows[i]):
            p = (words[w] + 0.5) / (total + 0.5 * (distinct + 1))
            if words[before]:
                p = max(pairs[before, w] - 0.75, 0) / words[before] + 0.75 * follow[before] / words[before] * p
            bigram += math.log10(p)
    score, n = sum(r["score"] for r in held.values()), sum(r["n_tokens"] for r in held.values())
    print("model", score / n, "bigram", bigram / n, "base", sum(r["base_score"] for r in held.values()) / n)
    assert score > bigram
