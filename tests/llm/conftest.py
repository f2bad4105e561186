import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[2]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """The rows of documents, as dictionaries."""
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in each column, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, None, None),
        (None, "one two three four", "en", "a", 18),
        (4, "One TWO three four", "en", "a", 18),
        (4, "One TWO three four", "en", "a", 18),
        (5, "word " * 60_000, "en", "b", 300_000),
        (6, "é" * 40 + " straße 中文 😀 token = abcdef123456", "de", "b", 70),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    return docs.selectExpr("*", "1 as fp", "'x' as spans", "2 as kept", "3 as n_words", "4 as `group`", "5 as row", "6 as kept_id", "7 as base_spans", "8 as all_spans")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
