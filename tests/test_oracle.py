"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import pytest
from compare import difference

import __spark_entry__ as contract
from catalog.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, duck, name):
    assert difference(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and len(rows) <= 14
