"""Where the smallest tables lie, and how a query's rows are compared with its SQL."""

from __future__ import annotations

from pathlib import Path

SF = "/root/testdata/sf0.001"


def duckdb_tables(folder: str = SF):
    """A DuckDB connection with a view on each table of ``folder``."""
    import duckdb

    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else path
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
    return connection


def assert_same_rows(got, want) -> None:
    """Both tables, given as pandas frames, have the same columns and, in any order, the same rows."""
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    left, right = (df[columns].astype(str).sort_values(columns).reset_index(drop=True) for df in (got, want))
    assert left.equals(right)
