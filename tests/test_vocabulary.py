import json
import random
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from small_tables import SF
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from ananym.config import VocabConfig
from ananym.functions.text import nfkc
from ananym.functions.text import words as text_words
from ananym.operators import vocabulary, words
from ananym.operators.pair_index import Block, Merges, PairIndex, key_of, pair_of
from ananym.operators.vocabulary import (
    END_OF_SYMBOLS,
    Tokens,
    certain_merges,
    independent_merges,
    symbol,
    train_vocabulary,
    vocabulary_report,
)
from ananym.operators.words import (
    character_counts,
    initial_ids,
    pair_counts,
    restrict_to_alphabet,
    top_alphabet,
    word_counts,
)
from ananym.sources.vocabulary import load_vocabulary, save_vocabulary


def counted(words):
    pairs = Counter()
    for word, n in words.items():
        for i in range(len(word) - 1):
            pairs[word[i : i + 2]] += n
    return pairs


def one_by_one(words, alphabet, cap, least):
    """The definition: one merge at a time over all words."""
    tokens = Tokens(alphabet)
    while len(tokens) < cap:
        ranked = sorted((-n, p) for p, n in counted(words).items() if n >= least)
        if not ranked:
            break
        pair = ranked[0][1]
        new, _ = tokens.merge(pair)
        words = merge_words(words, [(pair, new)])
    return tokens


def merge_words(words, merges):
    out = Counter()
    for word, n in words.items():
        for pair, new in merges:
            word = word.replace(pair, new)
        out[word] += n
    return out


def in_rounds(words, alphabet, cap, least, lookahead):
    tokens = Tokens(alphabet)
    while len(tokens) < cap:
        ranked = [(p, -n) for n, p in sorted((-n, p) for p, n in counted(words).items() if n >= least)]
        if not ranked:
            break
        if lookahead:
            seen = ranked[:lookahead]
            last = (-least, END_OF_SYMBOLS) if len(seen) == len(ranked) else (-seen[-1][1], seen[-1][0])
            runs = Counter()
            pairs = {p for p, _ in seen}
            for word, n in words.items():
                ends = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs]
                for a, b in zip([0, *ends], [*ends, len(word)]):
                    if b - a > 1:
                        runs[word[a:b]] += n
            merges = certain_merges(list(runs.items()), last, tokens, cap)
        else:
            merges = independent_merges(ranked, tokens, cap)
        assert merges
        words = merge_words(words, merges)
    return tokens


@pytest.mark.parametrize("lookahead", [0, 1, 2, 3, 5, 8, 1000])
def test_rounds_equal_one_merge_at_a_time(lookahead):
    """Random words over few letters, so that ties, self-overlaps and spellings that exist already are common."""
    for seed in range(150):
        pick = random.Random(seed)
        letters = "abcd"[: pick.randint(1, 4)]
        words = Counter()
        for _ in range(pick.randint(1, 30)):
            word = "".join(pick.choice(letters) for _ in range(pick.randint(1, 12)))
            words["".join(symbol(letters.index(c) + 1) for c in word)] += pick.randint(1, 3)
        cap, least = pick.choice([8, 20, 200]), pick.choice([1, 2, 3])
        want = one_by_one(words, list(letters), cap, least)
        got = in_rounds(words, list(letters), cap, least, lookahead)
        assert (got.spellings, got.merges) == (want.spellings, want.merges), seed


def spark_words(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n bigint")


@pytest.mark.parametrize("limits", [(4096, 50_000, 256), (6, 50_000, 3), (40, 12, 16), (40, 0, 16)])
def test_spark_rounds_with_small_limits(spark, monkeypatch, limits):
    pairs, runs, first = limits
    monkeypatch.setattr(vocabulary, "MAX_PAIRS", pairs)
    monkeypatch.setattr(vocabulary, "MAX_RUNS", runs)
    monkeypatch.setattr(vocabulary, "FIRST_PAIRS", first)
    pick = random.Random(5)
    words = Counter("".join(pick.choice("abcde") for _ in range(pick.randint(1, 9))) for _ in range(300))
    trained = train_vocabulary(spark_words(spark, words), VocabConfig(18, 2, 500))
    symbols = {"".join(symbol("abcde".index(c) + 1) for c in w): n for w, n in words.items()}
    want = one_by_one(symbols, list("abcde"), 18, 2)
    merges = [(r["left"], r["right"]) for r in trained.merges.orderBy("rank").collect()]
    assert merges == [(want.spellings[a], want.spellings[b]) for a, b in want.merges]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.reverse("text").alias("text"))
    return docs.repartition(4, "doc_id").persist()


@pytest.mark.parametrize("cap,least,letters", [(2500, 5, 500), (400, 5, 40), (52_000, 5, 500)])
def test_same_as_public_tokenizer_library(spark, corpus, cap, least, letters):
    tokenizers = pytest.importorskip("tokenizers")
    trained = train_vocabulary(word_counts(corpus), VocabConfig(cap, least, letters))
    library = tokenizers.SentencePieceBPETokenizer()
    library.train_from_iterator(
        [r["text"] for r in corpus.collect()],
        vocab_size=cap,
        min_frequency=least,
        limit_alphabet=letters,
        show_progress=False,
    )
    model = json.loads(library.to_str())["model"]
    merges = [(r["left"], r["right"]) for r in trained.merges.orderBy("rank").collect()]
    assert merges == [tuple(m) for m in model["merges"]]
    base = {r["token"]: r["id"] for r in trained.vocab.collect() if r["token"] not in ("<s>", "</s>", "<pad>")}
    assert base == model["vocab"]
    row = vocabulary_report(trained.vocab).first()
    assert tuple(row) == (len(base) + 3, len(base), 0, len(base), len(base) + 1, len(base) + 2)


def test_counts_and_alphabet(spark):
    words = spark_words(spark, {"aaa": 2, "aaaa": 1, "abab": 3, "xyx": 1})
    assert {r["pair"]: r["n"] for r in pair_counts(words).collect()} == {"aa": 7, "ab": 6, "ba": 3, "xy": 1, "yx": 1}
    top = top_alphabet(character_counts(words), 3)
    assert [(r["ch"], r["n"]) for r in top.collect()] == [("a", 16), ("b", 6), ("x", 2)]
    kept = restrict_to_alphabet(words, top)
    assert {r["word"] for r in kept.collect()} == {"aaa", "aaaa", "abab", "xx"}
    assert [tuple(r) for r in initial_ids(top).orderBy("id").collect()] == [(0, "<unk>"), (1, "a"), (2, "b"), (3, "x")]


def test_saved_vocabulary_is_the_same(spark, tmp_path):
    trained = train_vocabulary(spark_words(spark, {"▁abab": 9, "▁ab": 3}), VocabConfig(20, 2, 500))
    save_vocabulary(trained, str(tmp_path / "v"))
    loaded = load_vocabulary(spark, str(tmp_path / "v"))
    for table, key in (("vocab", "id"), ("merges", "rank")):
        a, b = getattr(trained, table), getattr(loaded, table)
        assert a.orderBy(key).collect() == b.orderBy(key).collect()


def test_nothing_to_learn(spark):
    trained = train_vocabulary(spark_words(spark, {"▁": 3}), VocabConfig(20, 2, 500))
    assert trained.merges.count() == 0
    assert [r["token"] for r in trained.vocab.orderBy("id").collect()] == ["<unk>", "▁", "<s>", "</s>", "<pad>"]


def block_words(block):
    texts = ["".join(symbol(i) for i in block.symbols[a:b].tolist()) for a, b in zip(block.starts, block.starts[1:])]
    return Counter({w: sum(n for v, n in zip(texts, block.counts.tolist()) if v == w) for w in set(texts)})


@pytest.mark.parametrize("seed", range(12))
def test_blocks_change_as_plain_replacement_does(seed):
    """Words, index and corrected counts after several rounds; short words and long ones, rows of one symbol among them."""
    source = random.Random(seed)
    letters = [symbol(i) for i in range(1, 4)]
    texts = ["".join(source.choices(letters, k=source.choice([2, 3, 7, 20, 63, 64, 65, 90]))) for _ in range(60)]
    words = Counter()
    for text in [*texts, letters[0] * 9, letters[0] * 100]:
        words[text] += source.randint(1, 3)
    block = Block.of(list(words), list(words.values()))
    counts = {pair_of(k): n for k, n in zip(*(x.tolist() for x in block.summed()))}
    tokens = Tokens(["a", "b", "c"])
    for cap in (6, 12, 40, 41, 300):
        assert counts == counted(words)
        merges = certain_merges(list(words.items()), (-1, END_OF_SYMBOLS), tokens, cap)
        if not merges:
            break
        pairs = sorted(key_of(p) for p in source.sample(sorted(counts), min(4, len(counts))))
        assert set(block.runs(np.array(pairs))) == {r for w in words for r in runs(w, set(map(pair_of, pairs)))}
        block, keys, changes, _ = block.merge(Merges.of(merges))
        for key, by in zip(keys.tolist(), changes.tolist()):
            counts[pair_of(key)] = counts.get(pair_of(key), 0) + by
        counts = {p: n for p, n in counts.items() if n}
        words = merge_words(words, merges)
        words = Counter({w: n for w, n in words.items() if len(w) > 1})
        assert block_words(block) == words
        assert (np.diff(block.keys) >= 0).all()
        assert Counter(zip(block.keys.tolist(), block.owners.tolist())) == Counter(
            (key_of(p + q), i) for i, (a, b) in enumerate(zip(block.starts, block.starts[1:])) for p, q in pairwise(map(symbol, block.symbols[a:b].tolist()))
        )


def runs(word, pairs):
    ends = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs]
    return [word[a:b] for a, b in zip([0, *ends], [*ends, len(word)]) if b - a > 1]


def test_later_rounds_touch_a_fraction_of_the_words(spark, corpus, monkeypatch):
    shares = []
    merge = PairIndex.merge

    def watched(index, merges):
        total = index.blocks.select(F.sum(F.octet_length("counts")) / 8).first()[0]
        merge(index, merges)
        shares.append(index.blocks.agg(F.sum("touched")).first()[0] / total)

    monkeypatch.setattr(PairIndex, "merge", watched)
    train_vocabulary(word_counts(corpus), VocabConfig(20_000))
    assert len(shares) > 4
    assert max(shares[3:]) < 0.8


def test_a_long_mixed_word_trains_in_seconds(spark):
    import time

    source = random.Random(4)
    word = "".join(source.choices("abcdefghijklmnopqrstuvwxyz0123456789", weights=range(1, 37), k=100_000))
    start = time.monotonic()
    trained = train_vocabulary(spark.createDataFrame([(word, 1), ("abc", 3)], "word string, n bigint"), VocabConfig(vocab_size=1_500, min_frequency=2))
    assert trained.vocab.count() == 1_503
    assert time.monotonic() - start < 90


def test_only_the_ranking_itself_reaches_the_driver(spark, monkeypatch):
    words = spark.range(3000).select(F.concat(F.expr("char(97 + id % 26)"), F.expr("char(97 + id % 23)"), F.expr("char(97 + id % 19)")).alias("word"), (F.col("id") % 7 + 1).alias("n"))
    spelled = F.translate("word", "abcdefghijklmnopqrstuvwxyz", "".join(map(symbol, range(1, 27)))).alias("word")
    index = PairIndex(words.repartition(8, "word").select(spelled, "n"))
    index.counts = index.counts.repartition(16, "pair")
    want = sorted(((pair_of(r["pair"]), r["n"]) for r in index.counts.where("n >= 9").collect()), key=lambda x: (-x[1], x[0]))
    collected, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: collected.append(df.columns) or collect(df))
    for most in (1, 40, 41, 10_000):
        assert index.top(most, 9) == want[:most]
    # A collected ranking would come from each of the tasks; counts by frequency are summed up before.
    assert collected and all(columns == ["step", "count"] for columns in collected)


@pytest.mark.parametrize("normalise", [True, False])
def test_words_are_counted_before_spark_sees_them(spark, edge_texts, monkeypatch, normalise):
    monkeypatch.setattr(words, "COUNTED_BYTES", 60)
    rows = [(t,) for t in [*edge_texts, None, *["some frequent words"] * 50]]
    df = spark.createDataFrame(rows, "text string").repartition(3)
    text = nfkc(F.col("text")) if normalise else F.col("text")
    want = Counter(r["word"] for r in df.select(F.explode(text_words(text)).alias("word")).collect())
    counted = word_counts(df, normalise=normalise)
    assert {r["word"]: r["n"] for r in counted.collect()} == want
    assert "Generate" not in counted._jdf.queryExecution().optimizedPlan().toString()
