"""Registered corpus queries against their SQL on the smallest tables."""

import pytest

from compare import assert_same, connect
from jobflow.llm import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.load_all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert_same(QUERIES[name](spark, SF), connect(SF), ORACLES[name])


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
