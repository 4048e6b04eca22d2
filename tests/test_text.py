import random
import sys
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from ananym.functions.text import (
    WHITESPACE,
    may_change_under_nfkc,
    nfkc,
    prefix,
    prefix_reversed,
    read_back,
    reverse_text,
    words,
)
from ananym.operators.rows import require_orientation, reverse_rows
from ananym.sources.corpus import from_rows


def table(spark, texts):
    return from_rows(spark, list(enumerate(texts)))


def column(df, c):
    return [r[0] for r in df.orderBy("doc_id").select(c).collect()]


def test_reverse_is_by_code_point_and_its_own_inverse(spark, edge_texts):
    df = table(spark, [*edge_texts, None])
    assert column(df, reverse_text(F.col("text"))) == [t[::-1] for t in edge_texts] + [None]
    assert column(df, reverse_text(reverse_text(F.col("text")))) == [*edge_texts, None]


def test_read_back_strips_all_whitespace(spark):
    assert set(WHITESPACE) == {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()}
    texts = [f"{a}x y{b}" for a in WHITESPACE for b in ("", "\n", "　 ")] + [WHITESPACE, ""]
    assert column(table(spark, texts), read_back(F.col("text"))) == [t[::-1].strip() for t in texts]


def test_prefixes(spark, edge_texts):
    texts = [*edge_texts, "0123456789" * 60]
    df = table(spark, texts)
    assert column(df, prefix(F.col("text"), 100)) == [t[:100] for t in texts]
    assert column(df, prefix_reversed(F.col("text"), 500)) == [t[500::-1] for t in texts]


def test_nfkc_on_every_character_and_on_random_mixes(spark, edge_texts):
    every = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cs", "Cn", "Co")]
    picker = random.Random(1)
    marks = [c for c in every if unicodedata.combining(c)] + [chr(c) for c in range(0x1161, 0x11FF)]
    letters = [c for c in every if unicodedata.category(c)[0] == "L"]
    mixes = ["".join(picker.choice(s) for s in (letters, marks, letters, marks)) for _ in range(20_000)]
    texts = [*edge_texts, *every, *mixes]
    df = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    text = F.col("text")
    done = df.select("doc_id", text, nfkc(text).alias("out"), may_change_under_nfkc(text).alias("may")).toPandas()
    assert (done["out"] == done["text"].map(lambda t: unicodedata.normalize("NFKC", t))).all()
    assert not done.loc[done["text"].str.contains("^[a-zäöüßéèçñ]*$", regex=True), "may"].any()


def test_words(spark):
    cases = {
        "": [],
        " ": ["▁"],
        " lead": ["▁lead"],
        "trail ": ["▁trail", "▁"],
        "hello  world\nfoo": ["▁hello", "▁", "▁world\nfoo"],
        "a ▁b": ["▁a", "▁", "▁b"],
        "▁x": ["▁x"],
    }
    assert column(table(spark, list(cases)), words(F.col("text"))) == list(cases.values())
    assert column(table(spark, [None]), words(F.col("text"))) == [[]]


def test_orientation_is_checked(spark):
    df = table(spark, ["abc"])
    once = reverse_rows(df)
    assert once.first()["orientation"] == "reversed"
    assert reverse_rows(once).first()["orientation"] == "forward"
    assert require_orientation(once, "reversed").first()["text"] == "cba"
    try:
        require_orientation(once, "forward").collect()
    except Exception as error:
        assert "text must be forward" in str(error)
    else:
        raise AssertionError("a text of the wrong orientation was accepted")
