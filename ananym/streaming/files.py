"""File streams: what needs no global order works on new files as they arrive.

The exact split, "first n" and batching need the whole table and stay batch-only.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ananym.operators.encoding import encode
from ananym.operators.limits import split_hash
from ananym.operators.rows import reverse_rows
from ananym.operators.sequences import fit_context
from ananym.operators.vocabulary import Vocabulary
from ananym.session import scratch_path
from ananym.sources.corpus import CORPUS_SCHEMA


def stream_corpus(
    spark: SparkSession,
    folder: str,
    pattern: str = "*",
    schema: T.StructType = CORPUS_SCHEMA,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Follow a folder; ``pattern`` selects files by name."""
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder)


def prepare_stream(corpus: DataFrame, test_size: float, seed: int = 0) -> DataFrame:
    """Split by hash and reverse, row by row and without state."""
    return reverse_rows(split_hash(corpus, test_size, seed))


def encode_stream(prepared: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id", "split"), match_special: bool = False) -> DataFrame:
    """Token ids of streamed documents that read right to left, document by document and without state."""
    return encode(prepared, vocabulary, keep, match_special=match_special)


def running_token_totals(tokens: DataFrame, by: str = "split", ids: str = "input_ids") -> DataFrame:
    """Rows and tokens so far for each ``by``, kept as state between the batches; the state has a row for each ``by``."""
    return tokens.groupBy(by).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.size(ids)), F.lit(0)).cast("bigint").alias("n_tokens"))


def cut_stream(tokens: DataFrame, context_length: int, mode: str) -> DataFrame:
    """Cut streamed token arrays to the context, in either mode."""
    return fit_context(tokens, context_length, mode)


def write_available(df: DataFrame, path: str, checkpoint: str | None = None, partition_by: list[str] = ()) -> StreamingQuery:
    """Process what is there now, exactly once, and stop.

    ``checkpoint`` must be kept between runs to continue from the last one; without it the run stands alone.
    """
    spark = df.sparkSession
    writer = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-checkpoint"))
        .trigger(availableNow=True)
        .outputMode("append")
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start(path)
    query.awaitTermination()
    return query


class RowCounter(StreamingQueryListener):
    """Rows read by each run of the session's streams, counted batch by batch as they end.

    ``StreamingQuery.recentProgress`` remembers only the latest batches; a listener sees every one.
    """

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event):
        self.rows.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event):
        self.rows[str(event.progress.runId)] = self.rows.get(str(event.progress.runId), 0) + event.progress.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.add(str(event.runId))


def counting_rows(spark: SparkSession) -> RowCounter:
    """Start counting the rows of this session's streams."""
    counter = RowCounter()
    spark.streams.addListener(counter)
    return counter


def progress(query: StreamingQuery, counter: RowCounter, timeout: float = 60.0) -> int:
    """Rows read so far by this run of a stream; for one that has ended, once its end has been told.

    An end that is not told within ``timeout`` seconds is an error, as some batches may be missing. Totals that outlive the session are
    kept by :mod:`ananym.streaming.ledger`.
    """
    until = time.monotonic() + timeout
    while not query.isActive and str(query.runId) not in counter.ended:
        if time.monotonic() > until:
            raise TimeoutError("the end of the stream was not reported; its rows so far may be incomplete")
        time.sleep(0.05)
    return counter.rows.get(str(query.runId), 0)
