import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tagloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate one column expression."""
    one = spark.range(1)
    return lambda column: one.select(column.alias("v")).first()["v"]
