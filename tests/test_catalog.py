import pytest
from conftest import SMALL
from oracle import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(queries()[name](spark, SMALL), con, SQL[name]) == ""


def test_entry(spark):
    assert entry(spark).count() == 3


def test_names():
    assert set(SQL) <= set(queries())
