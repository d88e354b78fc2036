"""Every query with SQL gives the SQL's rows; the others run."""

import os

import numpy as np
import pytest

from tests.compare import connect, rows
from vellum.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
SQL = registry.oracle_sql()
#: Columns whose values are bounded by what they are, wherever a query without SQL returns them.
UNIT = {"rho": (-1, 1), "p": (0, 1), "w": (0, 1), "share": (0, 1), "success_rate": (0, 1), "low": (-1e12, 1e12), "mean_rho": (-1, 1), "max_abs_rho": (0, 1)}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    found = registry.queries()[name](spark, DATA).toPandas()
    if name in SQL:
        assert rows(found) == rows(con.sql(SQL[name]).df())
    else:
        assert len(found.columns) == len(set(found.columns)) and len(found)
        for c in found.columns:
            values = found[c].dropna()
            assert len(values), f"{c} has no value"
            if values.dtype.kind == "f":
                assert np.isfinite(values).all(), f"{c} isn't finite"
            if c in UNIT:
                assert values.between(*UNIT[c]).all(), f"{c} is out of range"


def test_entry_without_llm():
    assert set(SQL) <= set(registry.queries())
