import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from siltwork import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield session.prepare(s)
    s.stop()


@pytest.fixture
def rows():
    """The rows of a frame as a sorted list of tuples."""
    return lambda df: sorted(map(tuple, df.collect()), key=repr)
