import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from roomledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests")


@pytest.fixture
def rows(spark):
    """Build a frame: ``rows("a int, b string", (1, "x"), ...)``."""

    def make(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return make


def values(df):
    return [tuple(r) for r in df.collect()]


def unordered(df):
    return sorted(values(df), key=repr)
