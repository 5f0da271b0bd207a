"""The engine from ``spark.sql``: published answers, ids nobody knows, and plans that read one entity only."""

from __future__ import annotations

import pytest

from surety.model import PARTNER_SIGNALS
from surety.operators import metrics
from surety.plans.assess import assess
from surety.plans.sql_functions import FUNCTIONS, register_functions
from surety.sources import star

AS_OF = "2024-03-01 23:30:00"
FOLDER = "/root/testdata/sf0.001"
BOUND = [metrics.MetricBinding("RAW.LIABILITIES", "liability_id", "DUPLICATE_COUNT", "UNIQUENESS"),
         metrics.MetricBinding("RAW.INCOME_VERIFICATION", "gross_annual_income", "NULL_COUNT", "COMPLETENESS"),
         metrics.MetricBinding("RAW.LIABILITIES", "applicant_id", "ORPHAN_COUNT", "INTEGRITY")]


@pytest.fixture(scope="module")
def sql(spark, lending, thresholds):
    lending.applicants.createOrReplaceTempView("people")
    names = register_functions(spark, lending, AS_OF, thresholds, bindings=BOUND,
                               parents={"applicant_id": (lending.applicants, "applicant_id")})
    assert set(names) == set(FUNCTIONS)
    return spark.sql


def test_the_published_decisions(sql, spark, lending, thresholds):
    want = {r.applicant_id: r for r in assess(lending, "AGENT", AS_OF, thresholds).audit.collect()}
    got = sql("SELECT r.* FROM (SELECT assess(applicant_id, 'AGENT') AS r FROM people)").collect()
    assert len(got) == 60
    for r in got:
        w = want[r.applicant_id]
        assert (r.decision_id, r.decision, r.reason, r.trust_verdict, r.dti_pct, r.risk_tier, r.outstanding_exposure) == (
            w.decision_id, w.decision, w.decision_reason, w.trust_verdict, w.dti_pct, w.risk_tier, w.outstanding_exposure)
    (one,) = sql("SELECT * FROM assess_of('APP-10042', 'AGENT')").collect()
    assert (one.decision, one.decision_id) == ("REFER_TO_HUMAN", want["APP-10042"].decision_id)
    other = sql("SELECT assess('APP-10042', 'SOMEBODY ELSE').decision_id AS id, assess('APP-10042', CAST(NULL AS STRING)).decision_id AS none").first()
    assert len({one.decision_id, other.id, other.none}) == 3


def test_verdicts_also_of_strangers_and_nobody(sql):
    known = sql("SELECT entity_trust('APP-10042') AS t").first().t
    assert (known.verdict, known.worst_staleness_days, known.blocking_failures) == ("NOT_TRUSTED", 42, ["LIABILITY_FEED_STALENESS"])
    stranger = sql("SELECT entity_trust('APP-99999') AS t").first().t       # owns a liability, but never applied
    assert stranger.income_missing and stranger.verdict == "NOT_TRUSTED" and stranger.applicant_id == "APP-99999"
    nobody = sql("SELECT entity_trust('nobody') AS t").first().t
    assert (nobody.applicant_id, nobody.blocking_failures, nobody.stale_feeds) == ("nobody", ["INCOME_COMPLETENESS"], [])
    assert sql("SELECT * FROM entity_trust_of('nobody')").count() == 0 and sql("SELECT * FROM entity_trust_of('APP-99999')").count() == 1
    empty = sql("SELECT assess('nobody', 'AGENT') AS a, assess(CAST(NULL AS STRING), 'AGENT') AS b, assess('APP-99999', 'AGENT') AS c").first()
    assert empty.a is None and empty.b is None and empty.c is None
    assert sql("SELECT * FROM assess_of('nobody', 'AGENT')").count() == 0


def test_functions_meet_columns_in_one_join(sql):
    rows = sql("""SELECT p.applicant_id, t.verdict, entity_trust(p.applicant_id).verdict AS again, feed_status('RAW.LIABILITIES', 'BUREAU_TU') AS feed
                  FROM people p, LATERAL entity_trust_of(p.applicant_id) t""").collect()
    assert len(rows) == 60 and sum(r.verdict == "NOT_TRUSTED" for r in rows) == 22
    assert all(r.verdict == r.again and r.feed == "FAIL" for r in rows)


def test_metrics_by_scope_name(sql):
    r = sql("""SELECT lagging_records('RAW.LIABILITIES') AS lag, lagging_records('RAW.NOTHING') AS none,
        metric_value('RAW.LIABILITIES', 'liability_id', 'DUPLICATE_COUNT') AS dup,
        metric_value('RAW.INCOME_VERIFICATION', 'gross_annual_income', 'NULL_COUNT') AS nulls,
        metric_value('RAW.LIABILITIES', 'applicant_id', 'ORPHAN_COUNT') AS orphans, metric_value('a', 'b', 'c') AS unbound,
        feed_status('RAW.LIABILITIES', 'BUREAU_EQ') AS eq, feed_status('RAW.LIABILITIES', 'never') AS never""").first()
    assert tuple(r) == (53, None, 0, 2, 1, None, "PASS", None)
    rows = {x.feed_name: (x.record_count, x.lagging_records) for x in sql("SELECT * FROM lagging_by_feed('RAW.LIABILITIES')").collect()}
    assert rows == {"BUREAU_EQ": (113, 0), "BUREAU_TU": (53, 53)}


def test_only_the_metric_asked_for_is_in_the_plan(sql):
    plan = sql("SELECT metric_value('RAW.LIABILITIES', 'liability_id', 'DUPLICATE_COUNT')")._jdf.queryExecution().optimizedPlan().toString()
    assert "liability_id" in plan and "gross_annual_income" not in plan


def test_table_wide_partner_signals_hold_for_nobody_too(spark, lending, thresholds):
    from datetime import datetime
    from decimal import Decimal

    partner = spark.createDataFrame([("s1", "RAW.LIABILITIES", "P", None, "RULE", "ACCURACY", Decimal(1), Decimal("12.50"), "FAIL", True,
                                      datetime(2024, 3, 1), "x")], PARTNER_SIGNALS)
    register_functions(spark, lending, AS_OF, thresholds, partner, strict=True)
    t = spark.sql("SELECT entity_trust('nobody') AS t").first().t
    assert str(t.partner_trust_index) == "12.50" and t.blocking_failures == ["INCOME_COMPLETENESS", "PARTNER_SIGNAL"]
    register_functions(spark, lending, AS_OF, thresholds)      # replaces the functions
    assert spark.sql("SELECT entity_trust('nobody').partner_trust_index AS i").first().i is None
    assert spark.sql("SELECT metric_value('a', 'b', 'c') AS m").first().m is None


def test_the_key_reaches_every_scan_and_nothing_runs_python(spark, thresholds):
    register_functions(spark, star.sources(spark, FOLDER), AS_OF, thresholds)
    for text in ("SELECT entity_trust(7)", "SELECT * FROM entity_trust_of(7)", "SELECT assess(7, 'AGENT')", "SELECT * FROM assess_of(7, 'AGENT')"):
        plan = spark.sql(text)._jdf.queryExecution().executedPlan().toString()
        assert not any(bad in plan for bad in ("Python", "Arrow", "CartesianProduct"))
        scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "s_suppkey" not in line]
        assert len(scans) >= 4      # suppliers stand under keys shifted by a constant, which no scan can turn round
        assert all("EqualTo(c_custkey,7)" in s or "EqualTo(o_custkey,7)" in s for s in scans), [s for s in scans if "EqualTo" not in s]
