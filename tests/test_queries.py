"""Every spatial query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from loomfield.plans.catalog import ORACLES, QUERIES
from tests.oracle import differences

TINY = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert differences(spark, name, TINY, QUERIES, ORACLES) == []
