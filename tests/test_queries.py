"""Every query that SQL can express, against DuckDB on the smallest tables; the flagship query runs as registered."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_oracles import compare, duck

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables not present")

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR).startswith("ok")


def test_flagship_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["model", "window_label", "windows"] and df.count() > 0
