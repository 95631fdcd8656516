import pytest


@pytest.fixture(scope="session")
def tables(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
