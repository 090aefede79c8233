import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from evidex.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, spark__driver__memory="6g")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """A small table from tuples and a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)


@pytest.fixture
def value(spark):
    """The value of an expression over one text."""
    from pyspark.sql import functions as F

    def run(expression, text):
        df = spark.createDataFrame([(text,)], "x string")
        return df.select(expression(F.col("x")).alias("v")).first()["v"]

    return run
