"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from tests.check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = entry_points.queries()[name](spark, SF_DIR).toPandas()
    assert compare(got, con.execute(entry_points.oracle_sql()[name]).df()) is None


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "sdnn" in df.columns
