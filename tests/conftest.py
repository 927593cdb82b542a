import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from annolake.session import local_session  # noqa: E402

# expressions are built while test modules load, which needs a session
SPARK = local_session("tests", cores="4", partitions=4, memory="6g")


@pytest.fixture(scope="session")
def spark():
    return SPARK


@pytest.fixture
def texts(spark):
    """Apply an expression to a list of values and return the results in order."""
    def apply(expression, values, schema="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
        return [r[0] for r in df.orderBy("i").select(expression).collect()]
    return apply
