"""Fixtures of the operators' tests."""

import pytest
from awkward import CLASH, ROWS
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def messy(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumn("source", F.lit("src0")).withColumn("n_chars", F.length("text").cast("long"))
    for name in CLASH:
        df = df.withColumn(name, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, id string, t int")
