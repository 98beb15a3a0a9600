"""Every registered query equals its SQL on the smallest data."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import check
from civicspark.plans import load_all

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


# The text operators have tests of their own; many of them have no SQL.
NAMES = sorted(load_all().QUERIES)


def test_every_query_has_sql():
    assert set(load_all().ORACLES) == set(NAMES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, message, _ = check.compare(spark, con, name, SF_DIR)
    assert ok, message


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns and not df.isEmpty()


def test_scan_reads_only_the_columns_it_needs(spark):
    plan = contract.queries()["dhondt_national"](spark, SF_DIR)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
