"""Every registered query that has a SQL twin against it, on the smallest tables; compare.py does the same on others."""

import pytest
from compare import compare, connect

from flowloom.plans.catalog import ORACLES, QUERIES

# Its forests take minutes; what it writes is checked by test_files_and_streams.py, the query by compare.py.
SLOW = {"q01_sweep"}
NAMES = sorted(set(ORACLES) - SLOW)


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, small, name):
    ok, note = compare(spark, con, QUERIES[name], ORACLES[name], small)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
