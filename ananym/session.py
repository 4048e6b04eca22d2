"""Helpers around the session: shared scratch folder, lineage cuts, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20
#: For rows of some MB: Parquet looks at the size of pages and row groups only after a hundred rows, and its reader holds a row group.
FAT_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, named by the cluster in ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="ananym-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{checkpoint_root(spark)}/ananym/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the length of texts: a task's batches lie outside the heap, on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))
    if now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal an input that arrives in fewer partitions than there are cores to all cores, before CPU-heavy work.

    That is a small table, or files that cannot be split. Any other input already scans as enough tasks and is returned
    unchanged, so at scale this adds no shuffle. The rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
