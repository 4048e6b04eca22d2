"""Corpus tables on files."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ananym.functions.hashing import seeded_hash
from ananym.operators.limits import present
from ananym.operators.order import indexed

CORPUS_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
)


def read_corpus(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    schema: T.StructType | None = CORPUS_SCHEMA,
    subset: Column | None = None,
    **options,
) -> DataFrame:
    """Open a corpus lazily, with a declared schema so that only those columns are scanned.

    ``fmt`` is any Spark file format: parquet, orc, json (one object per line, compressed or not), csv,
    text. ``subset`` names a part of the corpus as a predicate; on a partition column it prunes
    folders. A text file is one document when ``wholetext=True`` is given and otherwise holds one per
    line; its key comes from :func:`keyed_text`.
    """
    if fmt == "text":
        corpus = keyed_text(spark.read.format("text").options(**options).load(path))
    else:
        reader = spark.read.format(fmt).options(**options)
        corpus = (reader.schema(schema) if schema is not None else reader).load(path)
    return corpus if subset is None else corpus.where(subset)


def keyed_text(lines: DataFrame) -> DataFrame:
    """Key lines of text files by their number: files in path order, lines in file order, from 0.

    Lines are ranked inside one block of one file and offset by the counts of earlier blocks, of which there is
    one row each. How files are cut into blocks and packed into tasks does not change the numbers.
    """
    place = ["file", "block"]
    read = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text")
    )
    before = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    counts = read.groupBy(*place).agg(F.count("*").alias("n"), F.min("line").alias("first"))
    offsets = counts.select(*place, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # Within a block the line ids that Spark gives are consecutive, so no rows need to be ranked; with a row per block, no lines are shuffled.
    return read.join(F.broadcast(offsets), place).select((F.col("offset") + F.col("line") - F.col("first")).alias("doc_id"), "text")


def store_with_keys(df: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Write a corpus that has no unique key with one: numbers that are unique, not dense, and fixed by the writing."""
    df.drop(key).withColumn(key, F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def from_rows(spark: SparkSession, rows: list, schema: T.StructType = CORPUS_SCHEMA) -> DataFrame:
    """A table from in-memory rows; meant for tests and single prompts."""
    return spark.createDataFrame(rows, schema)


def bundle_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """Named tables as one table with a ``split`` column."""
    named = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    return reduce(DataFrame.unionByName, named)


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists", max_records_per_file: int = 0) -> None:
    """One folder per split, written where the rows are: no shuffle."""
    writer = df.write.mode(mode).partitionBy("split")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.parquet(path)


def write_shuffled(df: DataFrame, path: str, seed: int = 0, key: str = "doc_id", mode: str = "errorifexists") -> None:
    """Write splits in a seeded random order that a sequential reader of the files meets: one folder per split.

    ``position`` numbers the rows of a split from 0 in that order, which is that of the seeded hash of a unique key. Files hold
    consecutive positions, in the order of their names, and rows stand in them by position; so a range of positions is
    read from few files, and the order can be rebuilt whatever way Spark scans them.
    """
    hashed = df.withColumn("__digest", seeded_hash(seed, present(key)))
    numbered = indexed(hashed, "__digest", [key], "position", by=("split",)).drop("__digest")
    numbered.repartitionByRange("split", "position").sortWithinPartitions("split", "position").write.mode(mode).partitionBy("split").parquet(path)


def read_positions(spark: SparkSession, path: str, split: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Rows ``start`` to ``stop`` of a split that :func:`write_shuffled` wrote; the bounds reach the scan."""
    rows = spark.read.parquet(path).where((F.col("split") == split) & (F.col("position") >= start))
    return rows if stop is None else rows.where(F.col("position") < stop)


def disk_order(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``disk_order``: the number from 0 of each row of Parquet files as they lie on disk, files by name, within each value of ``by``."""
    placed = df.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    before = Window.partitionBy(*by).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    files = placed.groupBy(*by, "__file").agg(F.count("*").alias("__n"))
    offsets = files.select(*by, "__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    order = (F.col("__before") + F.col("__row")).cast("bigint")
    return placed.join(offsets, [*by, "__file"]).withColumn("disk_order", order).drop("__file", "__row", "__before")


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Reopen what :func:`write_splits` wrote; naming a split prunes the other folders."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def read_split_files(spark: SparkSession, files: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """Loose files, one or more per split, as one table with a ``split`` column."""
    return bundle_splits({name: spark.read.format(fmt).load(path) for name, path in files.items()})


MANIFEST_SCHEMA = "plan int, files bigint, files_digest string"


def _manifest(df: DataFrame) -> DataFrame:
    """What a copy was made from: the plan, with its paths, columns and predicates, and its files with their sizes and times."""
    files = df.inputFiles()
    row = df.sparkSession.range(1).select(F.lit(df.semanticHash()).cast("int").alias("plan"))
    if not files:
        return row.select("plan", F.lit(0).cast("bigint").alias("files"), F.lit("0").alias("files_digest"))
    # Only the listing is read, not the files; the digest does not depend on their order.
    listed = df.sparkSession.read.format("binaryFile").load(files)
    each = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return row.crossJoin(listed.agg(F.count("*").alias("files"), F.sum(each).cast("string").alias("files_digest")))


def keep_copy(df: DataFrame, path: str) -> DataFrame:
    """Keep a copy of a remote corpus: written at the first call and reused as long as it is a copy of the same rows.

    A manifest beside the copy, written last, says what it was made from. If it is missing, because a run broke off, or names
    another source, subset or set of columns, or files that have changed since, the copy is written again. Two plans are told
    apart by Spark's 32-bit hash of them.
    """
    spark = df.sparkSession
    wanted = _manifest(df).first()
    try:
        found = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/_manifest").collect()
    except AnalysisException:
        found = []
    if found != [wanted]:
        df.write.mode("overwrite").parquet(path)
        spark.createDataFrame([wanted], MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")
    return spark.read.schema(df.schema).parquet(path)
