import pytest

from edge import docs, rows


@pytest.fixture(scope="session")
def odd(spark):
    return docs(spark).cache()


@pytest.fixture(scope="session")
def odd_rows():
    return rows()


@pytest.fixture(scope="session")
def none(spark):
    return docs(spark, [])


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
