"""Every named query against its SQL on the smallest bundled tables."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from drovera.plans import load_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None
