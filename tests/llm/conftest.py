import pytest

from tests.llm.fixtures import SCHEMA, awkward


@pytest.fixture(scope="session")
def odd_rows():
    return awkward()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
