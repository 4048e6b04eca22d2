"""Projections and row maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ananym.config import FORWARD, REVERSED
from ananym.functions.text import reverse_text


def select_columns(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """Keep the named columns; a single name may be given bare."""
    return df.select(columns)


def remove_columns(df: DataFrame, columns: str | list[str]) -> DataFrame:
    return df.drop(*([columns] if isinstance(columns, str) else columns))


def map_rows(df: DataFrame, columns: dict[str, Column], remove: list[str] = ()) -> DataFrame:
    """One row in, one row out, as native column expressions."""
    return df.withColumns(columns).drop(*remove)


def map_batches(
    df: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    batch_size: int | None = None,
) -> DataFrame:
    """A Python function over batches of rows, which may return more or fewer rows than it got.

    Only for work that has no column expression. ``batch_size`` bounds what the function sees at once;
    without it a batch is whatever Spark sends.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = batch_size or max(len(batch), 1)
            for start in range(0, len(batch), step):
                yield function(batch.iloc[start : start + step])

    return df.mapInPandas(run, schema)


def explode_rows(df: DataFrame, array: Column, position: str, value: str, keep: list[str]) -> DataFrame:
    """One row per array element with its position: the native form of a batched map."""
    return df.select(*keep, F.posexplode(array).alias(position, value))


def reverse_rows(df: DataFrame, column: str = "text") -> DataFrame:
    """Reverse a text column and record which way it now reads."""
    before = F.col("orientation") if "orientation" in df.columns else F.lit(FORWARD)
    after = F.when(before == REVERSED, FORWARD).otherwise(REVERSED)
    return df.withColumns({column: reverse_text(F.col(column)), "orientation": after})


def require_orientation(df: DataFrame, expected: str, column: str = "text") -> DataFrame:
    """Fail the job on a row that reads the other way; a table without the column is taken on trust."""
    if "orientation" not in df.columns:
        return df
    wrong = F.concat(F.lit(f"text must be {expected}, found "), F.col("orientation"))
    checked = F.when(F.col("orientation") == expected, F.col(column)).otherwise(F.raise_error(wrong))
    return df.withColumn(column, checked)
