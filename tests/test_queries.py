"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from surety.plans.registry import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(QUERIES)  # queries of subpackages that may be absent have tests of their own


@pytest.fixture(scope="session")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    assert compare(df, duck, entry.oracle_sql()[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.queries()) and set(NAMES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_point_filter_reaches_every_scan(spark):
    df = entry.queries()["decisions"](spark, FOLDER).filter("applicant_id = 7")
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "s_suppkey" not in line]
    assert len(scans) >= 4  # suppliers stand under keys shifted by a constant, which no scan can turn round
    assert all("EqualTo(c_custkey,7)" in s or "EqualTo(o_custkey,7)" in s for s in scans)


def fact_scans(spark, name: str) -> int:
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return sum("FileScan parquet" in line and "o_orderkey" in line or "FileScan parquet" in line and "o_custkey" in line
               for line in plan.splitlines())


@pytest.mark.parametrize("name, most", [
    ("drift", 6), ("three_outcomes", 6), ("understated", 6), ("dti_long", 6), ("late_merge", 2), ("late_apply", 2),
    ("decision_audit", 2), ("recorded_ids", 1)])
def test_facts_are_read_few_times(spark, name, most):
    assert fact_scans(spark, name) <= most


def test_scans_read_only_what_is_used(spark):
    plan = entry.queries()["content_dups"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderpriority:string>" in scan
