"""Every query with SQL must equal it, here at the smallest scale."""

import pytest
from oracle_check import compare, connect, entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    result = compare(spark, duck, SF, name)
    assert result.startswith("ok"), result


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1
