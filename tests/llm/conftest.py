import pytest
from helpers import CLASHING, COLUMNS, odd_rows

DATA = "/root/testdata/sf0.001"
@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), COLUMNS)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
