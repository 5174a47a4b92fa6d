"""Every registered query against its SQL twin."""

import os

import pytest
from oracle import connect, differences

from spendlens.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    result = QUERIES[key](spark, SF_DIR)
    if key in ORACLES:
        found = differences(result, con, ORACLES[key])
        # The smallest data set need not have a match for every pattern.
        assert [f for f in found if f != "no rows to compare"] == []
    else:
        assert result.count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
