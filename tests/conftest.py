import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vigilmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4)
    yield s
    s.stop()


@pytest.fixture
def rows(spark):
    """Tables from tuples and a schema in DDL."""
    return lambda data, schema: spark.createDataFrame(data, schema)
