"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from check_oracle import compare, connect

from pairlens.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert not compare(spark, duck, FOLDER, name).startswith("FAIL"), compare(spark, duck, FOLDER, name)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
