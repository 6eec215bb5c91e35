"""Every registered query against its DuckDB oracle on the smallest test
tables (the driver runs the same gate at sf0.01)."""

from __future__ import annotations

import os

import pytest

import oracle_harness as H

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def _keys():
    from shoplens.plans import registry
    return sorted(registry.queries())


@pytest.fixture(scope="module")
def duck():
    return H.duck(SF)


def test_every_key_has_oracle():
    import __spark_entry__ as E
    assert set(_keys()) <= set(E.queries()) and set(_keys()) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "month" in df.columns and "total_sales" in df.columns


@pytest.mark.parametrize("key", _keys())
def test_query_matches_oracle(spark, duck, key):
    import __spark_entry__ as E
    r = H.compare(E.queries()[key](spark, SF), E.oracle_sql()[key], duck)
    assert r["ok"], r
