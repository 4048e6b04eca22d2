"""Counts that vocabulary training starts from."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ananym.config import LIMIT_ALPHABET, UNK
from ananym.functions.arrays import adjacent_pairs
from ananym.functions.text import characters, marked
from ananym.operators.columnar import slices, split_words

COUNTED_BYTES = 8 << 20


def training_text(df: DataFrame, split: str | None = "train", column: str = "text") -> DataFrame:
    """The text column of one split."""
    return (df if split is None else df.where(F.col("split") == split)).select(column)


def word_counts(df: DataFrame, column: str = "text", normalise: bool = True) -> DataFrame:
    """How often each word occurs.

    Texts are split and their words counted in Arrow batches, so that Spark adds up counts and not single words; adding is partial
    before the shuffle, so frequent words do not pile up.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(pc.fill_null(batch.column(0).cast(pa.string()), ""), COUNTED_BYTES):
                found = split_words(part, normalise=normalise)[0].value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    counts = df.select(column).mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.select(marked(F.col("word")).alias("word"), "n")


def character_counts(words: DataFrame) -> DataFrame:
    """How often each character occurs, from the word counts."""
    return (
        words.select(F.explode(characters(F.col("word"))).alias("ch"), "n")
        .groupBy("ch")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def top_alphabet(chars: DataFrame, limit: int = LIMIT_ALPHABET) -> DataFrame:
    """The ``limit`` most frequent characters; equal counts are cut in character order."""
    return chars.orderBy(F.desc("n"), "ch").limit(limit)


def only(word: Column, alphabet: list[str]) -> Column:
    """Drop the characters of a word that are not in the alphabet."""
    known = "".join(f"\\x{{{ord(c):X}}}" for c in alphabet)
    return F.regexp_replace(word, f"[^{known}]", "") if known else F.lit("")


def restrict_to_alphabet(words: DataFrame, alphabet: DataFrame) -> DataFrame:
    """Drop other characters from the words; their neighbours become adjacent.

    The alphabet has at most ``limit_alphabet`` rows and becomes part of the plan.
    """
    return words.withColumn("word", only(F.col("word"), [r["ch"] for r in alphabet.collect()]))


def initial_ids(alphabet: DataFrame) -> DataFrame:
    """Id 0 for unknown, then the alphabet by code point. At most ``limit_alphabet`` rows are ranked."""
    spark = alphabet.sparkSession
    ranked = alphabet.select(F.row_number().over(Window.orderBy("ch")).alias("id"), F.col("ch").alias("token"))
    return spark.createDataFrame([(0, UNK)], "id int, token string").unionByName(ranked)


def pair_counts(words: DataFrame, column: str = "word") -> DataFrame:
    """How often two symbols stand next to each other, each word weighted by its count, overlaps included."""
    return (
        words.where(F.length(column) > 1)
        .select(F.explode(adjacent_pairs(characters(F.col(column)))).alias("pair"), "n")
        .groupBy("pair")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )
