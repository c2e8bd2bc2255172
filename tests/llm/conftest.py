import os

import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF


DOCS = "doc_id long, text string, source string, n_lines string, size string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, "a b c d e\nshared line here\nxyz", "s1", "x", "y"), (1, "a b c d e\nshared line here\nxyz", "s1", "x", "y"), (2, "", "s2", None, None), (3, None, "s1", "x", None),
        (4, "word " * 40_000, "s3", None, "z"), (None, "no id at all", None, None, None), (6, "a b c d e\nshared line here\nxyz", None, "x", "y"), (7, "   \n\n \t", "s2", "x", "y"), (8, "ñandú <|endoftext|> übung 🙂", "s1", "", ""),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
