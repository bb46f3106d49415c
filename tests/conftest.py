import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newsloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("*", 4)


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one Column per call on a single row."""

    def run(column):
        return spark.range(1).select(column.alias("v")).first()[0]

    return run


@pytest.fixture(scope="session")
def values(spark):
    """Apply a Column function to many single string inputs at once."""
    from pyspark.sql import functions as F

    def run(inputs, fn):
        df = spark.createDataFrame(list(enumerate(inputs)), "n int, x string")
        return [r[1] for r in df.select("n", fn(F.col("x")).alias("v")).orderBy("n").collect()]

    return run
