"""Every registered query with SQL must give the SQL's result; the others must give rows."""

from __future__ import annotations

import pytest

import compare
from plumbline.queries import ORACLES, QUERIES

HEAVY = ("k6_acquisition_back_test",)


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, con, name):
    assert compare.difference(QUERIES[name](spark, sf), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - set(HEAVY)))
def test_gives_a_table(spark, sf, name):
    out = QUERIES[name](spark, sf)
    assert out.columns
    out.count()


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert not [n for n in QUERIES if "pipeline" in n or n.startswith("op")]
