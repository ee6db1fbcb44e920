"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from compare import assert_same, connect
from jobflow.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.load_all()
#: checked row by row in test_searches.py instead: a chain of many stages that each have their SQL
WITHOUT_SQL = {"company_search"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert_same(df, con, ORACLES[name])
    else:
        assert name in WITHOUT_SQL, f"{name} has neither SQL nor a test of its own"
        assert df.count() > 0
