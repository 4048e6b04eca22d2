"""Mixing, sharding, substring removal and packing against plain versions."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pytest

from ananym.llm import mixing, packing, sharding, substrings
from ananym.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- mixing ---------------------------------------------------------------------------------------


def plain_targets(sizes: dict) -> dict:
    """Water level by bisection."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(2 * sizes[s], level * weight[s]) for s in order) < 1.5 * sum(sizes.values()):
            low = level
        else:
            high = level
    return {s: min(2 * sizes[s], low * weight[s]) for s in order}


def test_mix(edge_docs, edge_rows):
    placed = mixing.curriculum(edge_docs, mixing.word_count(), ["doc_id", "source"])
    rows = placed.collect()
    assert len(rows) == len(edge_rows)
    assert sorted(map(str, placed.collect())) == sorted(map(str, rows))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for _, text, source in edge_rows:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        largest[source] = max(largest[source], n)
    want = plain_targets(sizes)
    for r in rows:
        assert r["taken"] == r["size"] * len(r["positions"]) <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-6)
        assert list(r["positions"]) == sorted(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source] / 2 + 1e-6


def test_demand_is_inverted(spark):
    from pyspark.sql import functions as F

    schedule = (1.5, 1.0, 0.5)
    for x, t in spark.range(101).select((F.col("id") / 100).alias("x"), mixing.demand_inverse(F.col("id") / 100, schedule).alias("t")).collect():
        area = 1.5 * t - 0.5 * t * t  # of the line from 1.5 to 0.5
        assert area == pytest.approx(x, abs=1e-9)


def test_mixed_rows(edge_docs, edge_rows, no_docs):
    out = mixing.mixed(edge_docs)
    assert out.columns == edge_docs.columns
    rows, sizes, taken = out.collect(), Counter(), Counter()
    for _, text, source in edge_rows:
        sizes[source] += len(WORD.findall(text or ""))
    for r in rows:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= 4000
    given = Counter((i, t) for i, t, _ in edge_rows)
    assert all(n <= 2 * given[key] for key, n in Counter((r["doc_id"], r["text"]) for r in rows).items())
    assert mixing.mixed(no_docs).count() == 0


# --- sharding -------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    import numpy as np

    out = sharding.permute(np.arange(n), n, 3)
    assert sorted(out.tolist()) == list(range(n))


def test_shards(edge_docs, edge_rows, no_docs):
    out = sharding.shard_rows(edge_docs, 7).collect()
    shards = defaultdict(list)
    for r in out:
        shards[r["shard"]].append(r["slot"])
    counts = [len(s) for s in shards.values()]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    content = lambda t: (t or "").encode()
    want = Counter((i, len(content(t)) + 16, zlib.crc32(content(t))) for i, t, _ in edge_rows)
    assert want == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out)
    assert sharding.shard_rows(no_docs, 7).count() == 0


# --- substrings -----------------------------------------------------------------------------------


def plain_removal(rows: list[tuple], span: int) -> dict:
    documents = sorted({(i, t or "") for i, t, *_ in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for key, text in documents:
        found = WORD.findall(text)
        gone = [False] * len(found)
        for s in range(len(found) - span + 1):
            window = tuple(found[s : s + span])
            if window in seen:
                gone[s : s + span] = [True] * span
            seen.add(window)
        out[key, text] = [w for w, g in zip(found, gone) if not g]
    return out


def test_removal(edge_docs, edge_rows, no_docs):
    want = plain_removal(edge_rows, 20)
    assert sum(len(WORD.findall(t)) - len(k) for (_, t), k in want.items()) > 300
    out = substrings.remove_repeats(edge_docs, keep=["doc_id", "text"]).collect()
    assert len(out) == len(edge_rows)
    for r in out:
        kept = want[r["doc_id"], r["text"] or ""]
        assert WORD.findall(r["kept"] or "") == kept
        assert (r["n_words"], r["n_removed"]) == (len(WORD.findall(r["text"] or "")), len(WORD.findall(r["text"] or "")) - len(kept))
    assert substrings.remove_repeats(no_docs).count() == 0
    cut = substrings.without_repeats(edge_docs, length="n_chars")
    assert cut.columns == edge_docs.columns and cut.count() == len(edge_rows)
    assert cut.where("n_chars <> length(text)").count() == 0


def test_removal_of_few_symbols(spark):
    """Small alphabets make branching graphs, periodic runs and ties of anchors."""
    import random

    source = random.Random(2)
    rows = [(i, " ".join(source.choices("ab", weights=(4, 1), k=source.randint(0, 90)))) for i in range(120)]
    want = plain_removal(rows, 8)
    for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 8, keep=["doc_id", "text"]).collect():
        assert WORD.findall(r["kept"]) == want[r["doc_id"], r["text"]]


# --- packing --------------------------------------------------------------------------------------


def test_pieces(edge_docs, edge_rows, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t, _ in edge_rows)
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in packing.pack(edge_docs.coalesce(1), tokenizer_path(), keep=("doc_id", "text"), as_array=True).collect():
        sequences[r["sequence_id"]].append(r)
        documents[r["doc_id"], r["text"]].append(r)
        assert len(r["ids"]) == r["length"]
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == pieces[0]["sequence_length"] <= pieces[0]["padded_length"] <= 1024
    held = Counter(len(p) for p in sequences.values())
    assert held
    tokens = sum(p[0]["sequence_length"] for p in sequences.values())
    assert sum(p[0]["padded_length"] for p in sequences.values()) - tokens < 1024
    for (key, text), pieces in documents.items():
        ids = tuple(tokenizer.encode(text or "", add_special_tokens=False).ids) + (0,)
        copies = want[key, ids]
        by_start = defaultdict(list)
        for r in pieces:
            assert r["doc_tokens"] == len(ids) and tuple(r["ids"]) == ids[r["start"] : r["start"] + r["length"]]
            by_start[r["start"]].append(r["length"])
        assert sum(r["length"] for r in pieces) == copies * len(ids)
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_encoder_equals_library():
    import random

    import pyarrow as pa

    encoder = packing.Encoder(tokenizer_path())
    source = random.Random(1)
    alphabet = [*"ab é'sstmdvreLL 12½ \n\t .,!'’中👩‍  ́Ⅷ", "<|endoftext|>", "'re", "'s ", "  "]
    texts = ["".join(source.choices(alphabet, k=source.randint(0, 60))) for _ in range(3000)] + ["", None, "'", "'s", "a's", "x" * 5000]
    ids, starts = encoder.encode(pa.array(texts))
    for i, e in enumerate(encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[starts[i] : starts[i + 1]].tolist() == [*e.ids, 0]


def test_steps_are_balanced():
    lengths = [1024] * 50 + [512] * 20 + [128] * 16
    steps = packing.balance_steps(lengths)
    loads = Counter()
    for length, step in zip(lengths, steps):
        loads[step] += length
    assert max(loads.values()) - min(loads.values()) <= 1024
