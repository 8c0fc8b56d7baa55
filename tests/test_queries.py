from __future__ import annotations

import pytest
from tests.compare import difference, duck

from graphloom.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
#: Queries whose right answer on the small tables is no row at all.
EMPTY_OK = frozenset({"exists_none"})


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    found = difference(QUERIES[name](spark, sf), con, SQL[name])
    assert found in ("", "both empty") if name in EMPTY_OK else not found, found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
