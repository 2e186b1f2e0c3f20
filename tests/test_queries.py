"""Every registered query next to its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from loginlake.plans import catalog, oracle
from tests.oracle import compare, connection

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(name, QUERIES[name](spark, SF), con, SQL[name]) == ""


def test_flagship(spark):
    assert entry.entry(spark).columns == ["user", "source_ip", "source_display", "value"]
