"""Every stage of the pipeline against a plain version, on what the stage before it kept."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from small_tables import SF
from test_models import bag
from test_text_operators import WORD, plain_removal, plain_targets

import corpus_pipeline
from ananym.llm import toxicity
from ananym.llm.common import written
from ananym.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—"


def plain_toxicity(text: str | None, model: toxicity.SeverityModel) -> float:
    """P(toxic) from the words of a text and their beginnings."""
    times = Counter()
    for word in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
        bare = word.strip(MARKS)
        times.update([bare, *[bare[:n] + "*" for n in (4, 5, 6) if len(bare) >= n]] if bare else [])
    score = sum(model.weights[model.features[f]] * math.log1p(n) for f, n in times.items() if f in model.features)
    return 1 / (1 + math.exp(model.thresholds[0] - score))


def plain_groups(rows: list[tuple]) -> dict:
    """Key and text to the least key of its group; equal texts are linked, and texts whose five-word bags overlap by 0.8."""
    keys = defaultdict(list)
    for key, text in rows:
        if text is not None:
            keys[text].append(key)
    least = {text: min(own) for text, own in keys.items()}
    bags = [(text, bag(text)) for text in keys if WORD.search(text)]
    links = []
    for x, (s, a) in enumerate(bags):
        for t, b in bags[:x]:
            if 0.8 * max(a.total(), b.total()) <= min(a.total(), b.total()) and (a & b).total() >= 0.8 * (a | b).total():
                links.append((s, t))
    changed = True
    while changed:
        changed = False
        for s, t in links:
            root = min(least[s], least[t])
            changed |= least[s] != root or least[t] != root
            least[s] = least[t] = root
    return {(key, text): key if text is None else least[text] for key, text in rows}


@pytest.fixture(scope="module")
def stages(spark, edge_docs):
    """What goes into each stage and what comes out of the last one."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    edges = edge_docs.where("doc_id IS NOT NULL").select((F.col("doc_id") + 100_000).alias("doc_id"), *COLUMNS[1:])
    tables = [written(documents.unionByName(edges), "test-pipeline")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], SF), f"test-{name}"))
    return tables


def pairs(table):
    return [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]


def test_all_but_the_last_stage_keep_the_columns(stages):
    assert all(t.dtypes == stages[0].dtypes for t in stages[1:-1])


def test_toxic_documents_go(spark, stages):
    given, left = pairs(stages[0]), pairs(stages[1])
    model = toxicity.fit_severity(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = Counter(row for row in given if plain_toxicity(row[1], model) < toxicity.REJECT)
    assert Counter(left) == want
    assert 0 < len(given) - len(left) < len(given) / 4


def test_one_document_of_each_group_stays(stages):
    given, left = pairs(stages[1]), pairs(stages[2])
    groups = plain_groups(given)
    assert Counter(left) == Counter({row for row in given if groups[row] == row[0]})
    assert len(given) > len(left) + 5


def test_repeated_passages_go(stages):
    given = pairs(stages[2])
    want = plain_removal(given, 20)
    cut = stages[3].collect()
    assert Counter((r["doc_id"], tuple(WORD.findall(r["text"] or ""))) for r in cut) == Counter((key, tuple(want[key, text or ""])) for key, text in given)
    assert all(r["n_chars"] == len(r["text"]) for r in cut if r["text"] is not None)
    assert sum(len(WORD.findall(t or "")) - len(want[k, t or ""]) for k, t in given) > 100


def test_sources_come_near_their_targets(stages):
    given, taken = stages[3].collect(), stages[4].collect()
    size = lambda r: len(WORD.findall(r["text"] or ""))
    sizes, largest, words = Counter(), Counter(), Counter()
    for r in given:
        sizes[r["source"]] += size(r)
        largest[r["source"]] = max(largest[r["source"]], size(r))
    for r in taken:
        words[r["source"]] += size(r)
    for source, target in plain_targets(sizes).items():
        assert abs(words[source] - target) <= largest[source] / 2 + 1e-6
    copies, there = Counter(map(tuple, taken)), Counter(map(tuple, given))
    assert all(n <= 2 * there[row] for row, n in copies.items())


def test_pieces_rebuild_every_document(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter((key, i, token) for key, text in pairs(stages[4]) for i, token in enumerate([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]))
    got, sequences = Counter(), defaultdict(list)
    for r in stages[5].collect():
        got.update((r["doc_id"], r["start"] + i, token) for i, token in enumerate(r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], len(r["ids"])))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
