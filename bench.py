"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ananym.config import VocabConfig  # noqa: E402
from ananym.operators.encoding import BY_WORD, decode, encode  # noqa: E402
from ananym.operators.rows import map_batches, reverse_rows  # noqa: E402
from ananym.operators.sequences import CHUNK, TRUNCATE  # noqa: E402
from ananym.operators.words import character_counts, pair_counts, top_alphabet, word_counts  # noqa: E402
from ananym.plans import prepare_corpus, tokenise_corpus, train_tokenizer, training_batches  # noqa: E402
from ananym.session import scratch_path, spread  # noqa: E402
from ananym.sources.corpus import read_corpus, write_splits  # noqa: E402
from ananym.sources.vocabulary import load_vocabulary, save_vocabulary  # noqa: E402


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ananym-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ananym-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    warm: dict[str, float] = {}
    cold: dict[str, float] = {}

    def timed(name, work, repeat=True):
        """Seconds of the first run and of a second one; ``repeat`` is off where a run is long or writes to a named place."""
        for seconds in (cold, warm) if repeat else (cold,):
            start = time.perf_counter()
            work()
            seconds[name] = round(time.perf_counter() - start, 3)
        warm.setdefault(name, cold[name])
        print(name, cold[name], warm[name], file=sys.stderr, flush=True)

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    # The given file is one row group, which one task would read; a corpus has many.
    files = scratch_path(spark, "documents")
    given = read_corpus(spark, f"{folder}/documents.parquet")
    given.repartition(4 * int(cpus), "doc_id").write.parquet(files)
    n_rows = given.count()

    def docs():
        return read_corpus(spark, files)

    # Start the JVM's and Python's workers before anything is timed.
    spark.range(1000).groupBy(F.col("id") % 7).count().collect()
    run(map_batches(docs(), lambda batch: batch, docs().schema))
    prepared = scratch_path(spark, "prepared")
    timed("reverse_text", lambda: run(reverse_rows(docs())))
    timed("prepare_and_write", lambda: write_splits(prepare_corpus(docs()), prepared), repeat=False)
    corpus = spread(spark.read.parquet(prepared), "doc_id")
    timed("word_counts", lambda: run(word_counts(reverse_rows(docs()))))
    timed("alphabet_top", lambda: run(top_alphabet(character_counts(word_counts(reverse_rows(docs()))))))
    timed("pair_counts_first", lambda: run(pair_counts(word_counts(reverse_rows(docs())))))
    saved = scratch_path(spark, "vocabulary")
    timed("train_tokenizer_52k", lambda: save_vocabulary(train_tokenizer(corpus, VocabConfig(vocab_size=52_000)), saved), repeat=False)
    vocab = load_vocabulary(spark, saved)
    timed("encode_by_document", lambda: run(encode(corpus, vocab)))
    timed("encode_by_word", lambda: run(encode(corpus, vocab, strategy=BY_WORD)), repeat=False)
    tokens = scratch_path(spark, "tokens")
    timed("tokenise_chunk_and_write", lambda: tokenise_corpus(corpus, vocab, 1024, CHUNK).write.parquet(tokens), repeat=False)
    timed("tokenise_truncate", lambda: run(tokenise_corpus(corpus, vocab, 1024, TRUNCATE)))
    timed("decode", lambda: run(decode(spark.read.parquet(tokens), vocab)))
    timed("training_batches", lambda: run(training_batches(spark.read.parquet(tokens), vocab, 40)))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries, warm where run twice",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "reverse_rows_per_second": round(n_rows / warm["reverse_text"]),
                "sf": Path(folder).name,
            }
        )
    )


if __name__ == "__main__":
    main()
