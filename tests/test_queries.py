"""Every registered query against its SQL, on the smallest tables that still hold every case."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(queries())
# The full plan takes a minute; its two queries have tests of their own.
SLOW = {"build_plan", "plan_checks"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SLOW])
def test_query(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) is None


def test_entry(spark):
    assert set(entry(spark).columns) >= {"content_id", "replicas", "extra_bytes"}


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(NAMES)
