"""Training logs as tables of ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of training logs with the run they belong to and their place in it.

    ``run`` is a ``run=`` folder where there is one, else the file name. A run may span several files,
    taken in name order, and a large file several blocks, so no task needs a whole log.
    """
    lines = spark.read.text(path)
    run = F.col("run").cast("string") if "run" in lines.columns else F.col("_metadata.file_name")
    return lines.select(
        run.alias("run"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
