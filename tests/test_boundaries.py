"""Each limit just below, at and just above."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF
from surety.functions.clock import day_age, hour_age
from surety.functions.rules import counterfactual, policy_outcome, risk_tier
from surety.model import seed_thresholds
from surety.operators import audit as au
from surety.operators import decide, late, metrics, profile, signals, trust
from surety.plans.assess import assess


def debt(i, hours, balance="1000.00", applicant="A", kind="AUTO_LOAN", feed="TU", payment="10.00"):
    return (i, applicant, kind, balance, payment, feed, hours)


def test_three_cut_offs_for_one_age(make, thresholds, by):
    """Seven days old: fresh in the profile, failed in the verdict, breached in the lineage."""
    src = make([debt("d6", 144, "100.00", "A"), debt("d7", 168, "100.00", "B"), debt("d8", 192, "100.00", "C")],
               incomes=[("A", "60000"), ("B", "60000"), ("C", "60000")], applicants="ABC", repayments=())
    p = by(profile.credit_profile(src, AS_OF, thresholds))
    assert [p[k].pct_exposure_from_stale_feeds for k in "ABC"] == [D("0.00"), D("0.00"), D("100.00")]
    v = by(trust.entity_trust(src, AS_OF, thresholds))
    assert [v[k].verdict for k in "ABC"] == ["TRUSTED", "NOT_TRUSTED", "NOT_TRUSTED"]
    made = assess(src, "X", AS_OF, thresholds)
    lines = by(au.source_lineage(made.audit, made.sources, src.liabilities))
    assert [lines[k].record_breached_freshness for k in "ABC"] == [False, True, True]
    caught = by(late.feed_catch_up(src.liabilities, "TU", AS_OF), "liability_id")
    assert [caught[k].loaded_at.day for k in ("d6", "d7", "d8")] == [24, 23, 1]


def test_lag_is_strict(make):
    src = make([debt("new", 0), debt("edge", 168), debt("old", 169)])
    assert metrics.lagging_records(src.liabilities).first()[0] == 1


@pytest.mark.parametrize("hours, status", [(71, "PASS"), (72, "WARN"), (167, "WARN"), (168, "FAIL")])
def test_warn_and_fail_at_the_limit(make, thresholds, hours, status):
    # at 23:30 a record loses a calendar day every 24 hours once 23.5 hours have gone
    src = make([debt("d", hours - 23 if hours in (71, 167) else hours)])
    loads = signals.feed_loads({"RAW.LIABILITIES": src.liabilities})
    assert signals.grade_feeds(loads, AS_OF, thresholds).first().trust_status == status


@pytest.mark.parametrize("ratio, missed, tier", [
    ("29.99", 0, "TIER_1_LOW"), ("30.00", 0, "TIER_2_MODERATE"), ("29.99", 1, "TIER_2_MODERATE"),
    ("39.99", 1, "TIER_2_MODERATE"), ("40.00", 1, "TIER_3_ELEVATED"), ("20.00", 2, "TIER_3_ELEVATED"),
    ("49.99", 2, "TIER_3_ELEVATED"), ("50.00", 0, "TIER_4_HIGH"), ("10.00", 3, "TIER_4_HIGH"),
    ("10.00", None, "TIER_1_LOW"), (None, 0, "TIER_UNKNOWN"),
])
def test_tier_ladder(spark, ratio, missed, tier):
    row = spark.range(1).select(risk_tier(
        F.lit(1), F.lit(1), F.lit(ratio).cast("decimal(18,2)"), F.lit(missed).cast("int")).alias("t")).first()
    assert row.t == tier


@pytest.mark.parametrize("ratio, missed, policy, alone", [
    ("39.99", 1, "APPROVE", "APPROVE"), ("39.99", 2, "REFER_TO_HUMAN", "REFER_TO_HUMAN"),
    ("40.00", 0, "REFER_TO_HUMAN", "REFER_TO_HUMAN"), ("49.99", 2, "REFER_TO_HUMAN", "REFER_TO_HUMAN"),
    ("50.00", 0, "DECLINE", "DECLINE"), ("10.00", 3, "DECLINE", "DECLINE"),
    ("10.00", None, "APPROVE", "APPROVE"), (None, 0, "DECLINE", "UNDECIDABLE"),
])
def test_policy_ladder(spark, ratio, missed, policy, alone):
    r, m = F.lit(ratio).cast("decimal(18,2)"), F.lit(missed).cast("int")
    assert tuple(spark.range(1).select(policy_outcome(r, m), counterfactual(r, m)).first()) == (policy, alone)


@pytest.mark.parametrize("then, now, days, hours", [
    ("2024-02-29 23:59:00", "2024-03-01 00:01:00", 1, 1), ("2024-03-01 00:59:00", "2024-03-01 01:01:00", 0, 1),
    ("2024-03-01 01:01:00", "2024-03-01 01:59:00", 0, 0), ("2024-03-02 00:00:00", "2024-03-01 23:30:00", -1, -1),
])
def test_ages_count_boundaries(spark, then, now, days, hours):
    t = F.lit(then).cast("timestamp")
    assert tuple(spark.range(1).select(day_age(t, now), hour_age(t, now)).first()) == (days, hours)


def test_trusted_but_old_is_marked_for_review(spark, make):
    rows = [("LIABILITY_FEED_STALENESS", "TIMELINESS", "RAW.LIABILITIES", 3, 10, "days", True, "T", "r")]
    lenient = seed_thresholds(spark, rows)
    src = make([debt("d", 168)])
    made = assess(src, "X", AS_OF, lenient)
    row = au.audit_trail(made.audit, src.applicants).first()
    assert row.trust_verdict == "TRUSTED" and row.audit_assessment.startswith("REVIEW")


def test_count_metric_grading(spark, thresholds):
    rows = [("RAW.APPLICANTS", "employment_status", "INVALID_VALUE_COUNT", "VALIDITY", n) for n in (0, 1, 2, 3)]
    rows.append(("RAW.REPAYMENT_HISTORY", "x", "NULL_COUNT", "COMPLETENESS", 9))
    df = spark.createDataFrame(
        rows, "scope_object string, column_name string, metric string, signal_dimension string, measured bigint")
    got = [r.trust_status for r in metrics.grade_metrics(df, thresholds).orderBy("measured").collect()]
    assert got == ["PASS", "WARN", "WARN", "FAIL", "UNGOVERNED"]
