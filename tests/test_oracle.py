"""Every registered query against its SQL text on the test tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
from tests.oracle import compare, connect

SF_DIR = os.environ.get("FLEETGAUGE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query_agrees_with_sql(spark, con, name):
    sql = driver.oracle_sql().get(name)
    build = driver.queries()[name]
    if sql is None:
        assert build(spark, SF_DIR).count() >= 0
        return
    _, problems = compare(spark, con, build, sql, SF_DIR)
    assert not problems


def test_entry_runs(spark):
    df = driver.entry(spark)
    assert df.columns == ["cluster_id", "snapshot_ts", "schemaname", "relname", "total_dml", "total_scans", "n_dead_tup"]
    assert df.count() > 0
