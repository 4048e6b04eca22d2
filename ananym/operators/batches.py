"""Epoch order, batches, padding and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ananym.functions.arrays import attention_mask, labels, padded
from ananym.functions.hashing import seeded_hash
from ananym.operators.order import indexed


def epoch_order(df: DataFrame, seed: int = 0, epoch: int = 0, keys: tuple[str, ...] = ("doc_id", "chunk")) -> DataFrame:
    """Add ``position``: a seeded random order over all rows, another one for each epoch."""
    digest = seeded_hash(seed, epoch, *[F.col(k) for k in keys])
    return indexed(df.withColumn("__digest", digest), "__digest", list(keys), "position").drop("__digest")


def assign_batches(df: DataFrame, batch_size: int, position: str = "position") -> DataFrame:
    """Consecutive positions share a batch; the last batch may be short."""
    return df.withColumn("batch_id", F.floor(F.col(position) / batch_size))


def collate(df: DataFrame, pad_id: int, ids: str = "input_ids") -> DataFrame:
    """Pad each row to the longest of its batch, with attention mask and labels."""
    return _padded(df.withColumn("__width", F.max(F.size(ids)).over(Window.partitionBy("batch_id"))), pad_id, ids)


def _padded(df: DataFrame, pad_id: int, ids: str) -> DataFrame:
    width = F.col("__width")
    return df.withColumns(
        {
            "attention_mask": attention_mask(F.col(ids), width),
            "labels": labels(F.col(ids), width, pad_id),
            ids: padded(F.col(ids), width, pad_id),
        }
    ).drop("__width")


def shuffled_batches(
    df: DataFrame,
    batch_size: int,
    pad_id: int,
    seed: int = 0,
    epoch: int = 0,
    keys: tuple[str, ...] = ("doc_id", "chunk"),
    ids: str = "input_ids",
    length: str | None = None,
) -> DataFrame:
    """Epoch order, batches, padding and labels with one exchange of the token arrays.

    Rows are brought together once, by hash bucket, where they are ranked. A batch lies in one bucket or in neighbouring ones: its
    width inside a bucket needs no further exchange, and batches that cross a bucket's edge, fewer than there are buckets, get theirs
    from a small table made of the rows' keys and lengths alone. ``length`` names a column that holds the length of ``ids``.
    """
    size = F.col(length) if length else F.size(ids)
    hashed = df.withColumn("__digest", seeded_hash(seed, epoch, *[F.col(k) for k in keys]))

    def batched(rows: DataFrame) -> DataFrame:
        return assign_batches(indexed(rows, "__digest", list(keys), "position", bucket="__bucket"), batch_size)

    lengths = batched(hashed.select("__digest", *keys, size.alias("__size")))
    across = lengths.groupBy("batch_id").agg(F.max("__size").alias("__across"), F.min("__bucket").alias("__from"), F.max("__bucket").alias("__to"))
    across = across.where(F.col("__from") < F.col("__to")).select("batch_id", "__across")
    inside = F.max(F.size(ids)).over(Window.partitionBy("__bucket", "batch_id"))
    wide = batched(hashed).withColumn("__inside", inside).join(F.broadcast(across), "batch_id", "left")
    return _padded(wide.withColumn("__width", F.greatest("__inside", F.coalesce("__across", F.lit(0)))), pad_id, ids).drop(
        "__digest", "__bucket", "__inside", "__across"
    )
