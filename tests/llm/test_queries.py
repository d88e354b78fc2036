"""Every query of the subpackage on the smallest tables, and the found ones against plain Python."""

import os

import pytest

from tests.compare import connect, rows
from vellum.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    found = queries.queries()[name](spark, DATA).toPandas()
    if name in SQL:
        assert rows(found) == rows(con.sql(SQL[name]).df())
    if name.endswith("_found"):
        assert not found.duplicated().any()


def test_entry_has_both():
    import __spark_entry__ as entry

    assert set(queries.queries()) < set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
