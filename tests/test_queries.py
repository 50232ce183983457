"""Every registered query on the smallest tables, against its DuckDB counterpart where it has one."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert not df.isEmpty()
    else:
        assert compare(df, con, sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
