import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dqspark.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def contacts(spark):
    from dqspark.session import settle
    from dqspark.workload.contacts import contacts as make

    return settle(make(spark, SF), "test-contacts")


@pytest.fixture()
def table(spark):
    """Make a table with row ids from rows of values."""

    def make(schema, rows, start=0):
        data = [(start + i, *r) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, f"_row_id BIGINT, {schema}")

    return make
