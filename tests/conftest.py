import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from chatloom.session import local_session

    return local_session(8, "tests")


@pytest.fixture
def one(spark):
    """Evaluate one expression over literal columns given by name."""
    from pyspark.sql import functions as F

    def run(expression, **columns):
        schema = ", ".join(f"{n} {t}" for n, (t, _) in columns.items()) or "x int"
        row = tuple(v for _, v in columns.values()) or (0,)
        return spark.createDataFrame([row], schema).select(expression(F).alias("r")).first()["r"]

    return run
