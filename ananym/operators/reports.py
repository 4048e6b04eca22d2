"""Totals over corpora, token tables and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ananym.config import BatchConfig
from ananym.operators.sequences import CHUNK

# How a loss entry is written in a training log; the second form also takes exponents.
LOSS_ENTRY = r"\{'loss': ([\d\.]+),"
LOSS_ENTRY_EXTENDED = r"\{'loss': ([+-]?[\d\.]+(?:[eE][+-]?\d+)?),"


def corpus_report(df: DataFrame, by: list[str] = ("split",)) -> DataFrame:
    """Rows and characters per group."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.sum(F.length("text")).cast("bigint").alias("n_chars")
    )


def token_report(df: DataFrame, context_length: int, ids: str = "input_ids", by: list[str] = ("split",)) -> DataFrame:
    """Rows, rows x context length, and real tokens; the two totals differ when rows fall short of the context."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        (F.count("*") * context_length).alias("nominal_tokens"),
        F.coalesce(F.sum(F.size(ids)), F.lit(0)).cast("bigint").alias("actual_tokens"),
    )


def length_report(lengths: DataFrame) -> DataFrame:
    """The token report of both ways of cutting from document lengths alone: rows of ``size, context, mode``.

    Many modes and contexts need one scan, and no array is cut. Groups without rows are left out.
    """
    size, context = F.col("size"), F.col("context")
    rows = F.when(F.col("mode") == CHUNK, F.floor(size / context)).otherwise(F.lit(1))
    tokens = F.when(F.col("mode") == CHUNK, rows * context).otherwise(F.least(size, context))
    return (
        lengths.select("mode", "context", rows.cast("bigint").alias("rows"), tokens.cast("bigint").alias("tokens"))
        .groupBy("mode", "context")
        .agg(F.sum("rows").alias("n_rows"), (F.sum("rows") * F.col("context")).alias("nominal_tokens"), F.sum("tokens").alias("actual_tokens"))
        .where("n_rows > 0")
    )


def step_report(df: DataFrame, batch: BatchConfig, by: list[str] = ("split",)) -> DataFrame:
    """Sequences per optimiser step and steps for one epoch."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.lit(batch.accumulation_steps).cast("bigint").alias("accumulation"),
        F.lit(batch.global_batch).cast("bigint").alias("sequences_per_step"),
        F.ceil(F.count("*") / batch.global_batch).cast("bigint").alias("steps"),
    )


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows and characters while another action runs, without a job of its own."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("n_chars")), watch


def loss_history(lines: DataFrame, extended: bool = False) -> DataFrame:
    """``(run, step, loss)`` of every loss entry in a log, steps counted from 0 in reading order.

    Matches are ranked inside one block of one file and offset by the counts of the blocks before it,
    so a run with most of the lines is still spread over its blocks.
    """
    pattern = F.lit(LOSS_ENTRY_EXTENDED if extended else LOSS_ENTRY)
    place = ["run", "file", "block"]
    hits = lines.select(*place, "line", F.posexplode(F.regexp_extract_all("value", pattern, F.lit(1))).alias("nth", "found"))
    before = Window.partitionBy("run").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hits.groupBy(*place).agg(F.count("*").alias("n")).select(
        *place, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy(*place).orderBy("line", "nth")
    ranked = hits.withColumn("rank", F.row_number().over(inside))
    return ranked.join(offsets, place).select(
        "run", (F.col("offset") + F.col("rank") - 1).alias("step"), F.col("found").cast("double").alias("loss")
    )
