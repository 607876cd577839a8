"""Every registered query against its SQL oracle on the smallest tables."""

import pytest
from oracle import compare, duck

from plantloom.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, con, sf, name):
    ok, text = compare(spark, con, sf, name, QUERIES[name], ORACLES[name])
    assert ok, text
