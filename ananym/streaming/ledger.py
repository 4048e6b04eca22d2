"""Exact totals of streams: a ledger with one entry for each batch, which a batch that is run again overwrites."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"


def _write_batch(path: str, ledger: str, by: list[str], measures: dict[str, Column], rows: DataFrame, batch: int) -> None:
    """The rows first, then the entry, counted from what was written; a run that stops in between repeats both."""
    spark = rows.sparkSession
    own = f"{path}/{BATCH}={batch}"
    rows.write.mode("overwrite").parquet(own)
    stored = spark.read.schema(rows.schema).parquet(own)
    totals = stored.groupBy(*by).agg(F.count("*").alias("n_rows"), *[F.sum(m).cast("bigint").alias(name) for name, m in measures.items()])
    totals.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/{BATCH}={batch}")


def write_counted(
    df: DataFrame, path: str, ledger: str, checkpoint: str, by: tuple[str, ...] = (), measures: dict[str, Column] | None = None
) -> StreamingQuery:
    """Write what is there now, batch by batch, with an entry in the ledger for each: rows, and sums of ``measures``, for each ``by``.

    The checkpoint must be kept between runs. Batches have the same number and rows when they are run again after a failure, so data and
    entries are replaced and nothing counts twice. The call returns when all is written and fails if the stream does.
    """
    write = partial(_write_batch, path, ledger, list(by), measures or {})
    query = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def ledger_schema(df: DataFrame, by: tuple[str, ...] = (), measures: tuple[str, ...] = ()) -> T.StructType:
    counts = [T.StructField(name, T.LongType()) for name in ("n_rows", *measures)]
    return T.StructType([*(df.schema[name] for name in by), *counts, T.StructField(BATCH, T.LongType())])


def ledger_totals(spark: SparkSession, ledger: str, schema: T.StructType, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals over all batches that have ended, for each ``by``; one small row per batch and ``by`` is read."""
    counts = [f.name for f in schema if f.name not in (*by, BATCH)]
    entries = spark.read.schema(schema).parquet(ledger)
    return entries.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts])
