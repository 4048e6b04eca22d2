from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("ananym-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def edge_texts():
    return [
        "",
        " ",
        " lead",
        "trail ",
        "two  spaces",
        "a\nb",
        "a\r\nb",
        "tab\tx",
        "a ▁b",
        "▁▁x",
        "hello<s>",
        "</s>x<pad> y<unk>",
        "ﬁne",
        "éx",
        "́",
        "a\xa0b c",
        "１２ ½ ™",
        "👩‍👩‍👧 🇩🇪x",
        "nul\x00in",
        "zzQhello Q",
        "aaaaaaa aaaa",
        "ab" * 600,
    ]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
