from __future__ import annotations

import random

import pytest

#: Columns whose names operators might use themselves.
CLASHING = ("size", "word", "id", "kept", "severity", "rejected", "label", "h1", "__text", "__row", "__b", "n")


@pytest.fixture(scope="session")
def words():
    source = random.Random(5)
    syllables = ["ba", "do", "ke", "li", "mu", "na", "po", "ri", "so", "tu"]
    return ["".join(source.choices(syllables, k=source.randint(1, 3))) for _ in range(400)]


@pytest.fixture(scope="session")
def edge_rows(words):
    """(doc_id, text, source): nulls, empty and white texts, copies, near copies, shared passages, repeated rows, one long text."""
    source = random.Random(7)
    text = lambda n: " ".join(source.choices(words, k=n))
    passage = text(60)
    rows = [(i, text(source.randint(30, 120)), source.choice(["a", "b", "c", None])) for i in range(40)]
    rows += [(40 + i, f"{text(10)} {passage}\n{text(7)}", "a") for i in range(6)]
    base = text(90).split(" ")
    for i in range(8):
        near = list(base)
        near[source.randrange(90)] = f"x{i}"
        rows.append((50 + i, " ".join(near), "b"))
    rows += [(60, text(8000), "a"), (61, None, "b"), (62, "", None), (63, " \n\t ", "c"), (64, "one", "a"), (65, "one", "d"), (66, "Ein Wort é x", "a")]
    rows += [(67, "copy of a text that is here twice", "b")] * 3 + [(68, "copy of a text that is here twice", "a")]
    rows += [(None, "no key and a few words", "a"), (None, "no key and a few words", "a"), (None, None, None), (69, "la la la " * 30, "a"), (70, "<|endoftext|> inside", "c")]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows, "doc_id long, text string, source string")
    docs = docs.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
