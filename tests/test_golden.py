"""Published and independently recomputed values of the generated fixture."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal as D

from pyspark.sql import functions as F

from conftest import AS_OF
from surety.operators import audit as au
from surety.operators import dashboard, decide, metrics, profile, signals
from surety.operators.exposure import content_duplicates
from surety.plans.semantic import LENDING
from surety.sources import conformance
from surety.model import EMPLOYMENT_DOMAIN, SCOPES


def test_row_counts(lending):
    got = {r.table_name: r.row_count for r in conformance.row_counts(
        {SCOPES[n]: d for n, d in lending.items()}).collect()}
    assert got == {"RAW.APPLICANTS": 60, "RAW.INCOME_VERIFICATION": 60, "RAW.LIABILITIES": 166,
                   "RAW.REPAYMENT_HISTORY": 60}


def test_conforms(lending):
    assert conformance.conformance_report(lending).filter("violations > 0").count() == 0


def test_planted_defects(lending):
    assert metrics.lagging_records(lending.liabilities).first()[0] == 53
    assert metrics.duplicate_key_count(lending.liabilities, "liability_id").first()[0] == 0
    assert metrics.key_collisions(lending.liabilities, "liability_id").count() == 0
    dup = content_duplicates(lending.liabilities).collect()
    assert [(r.applicant_id, r.duplicate_groups, r.records_involved) for r in dup] == [("APP-10001", 1, 2)]
    row = metrics.orphan_count(lending.liabilities, lending.applicants, "applicant_id", "applicant_id").first()
    assert (row.orphan_records, row.orphan_keys) == (1, 1)
    bad = metrics.accepted_values(F.col("employment_status"), EMPLOYMENT_DOMAIN)
    assert lending.applicants.agg(bad).first()[0] == 2
    assert lending.income.agg(metrics.null_count(F.col("gross_annual_income"))).first()[0] == 2


def test_feeds(lending, thresholds):
    got = {r.feed_name: (r.record_count, r.staleness_days, r.trust_status)
           for r in signals.feed_trust(signals.scoped(lending), AS_OF, thresholds)
           .filter("scope_object = 'RAW.LIABILITIES'").collect()}
    assert got == {"BUREAU_EQ": (113, 0, "PASS"), "BUREAU_TU": (53, 42, "FAIL")}


def test_table_freshness_masks_the_stalled_feed(lending):
    seconds = lending.liabilities.agg(metrics.freshness(F.col("loaded_at"), AS_OF)).first()[0]
    assert seconds == 0
    per_feed = {r.feed_name: r.lagging_records for r in metrics.lagging_by_feed(lending.liabilities).collect()}
    assert per_feed == {"BUREAU_EQ": 0, "BUREAU_TU": 53}


def test_profile(lending, thresholds, by):
    rows = by(profile.credit_profile(lending, AS_OF, thresholds))
    assert len(rows) == 60
    assert Counter(r.risk_tier for r in rows.values()) == {
        "TIER_1_LOW": 12, "TIER_2_MODERATE": 12, "TIER_3_ELEVATED": 14, "TIER_4_HIGH": 20, "TIER_UNKNOWN": 2}
    r = rows["APP-10042"]
    assert (r.outstanding_exposure, r.monthly_obligations, r.dti_pct) == (D("421500.00"), D("3410.00"), D("31.97"))
    assert (r.gross_annual_income, r.risk_tier, r.pct_exposure_from_stale_feeds) == (
        D("128000.00"), "TIER_2_MODERATE", D("97.27"))
    assert r.liability_feeds_used == ["BUREAU_EQ", "BUREAU_TU"] and r.max_liability_staleness_days == 42
    assert Counter(x.worst_staleness_days_any_source for x in rows.values())[42] == 20


def test_decisions(lending, thresholds, by):
    rows = by(decide.decisions(lending, AS_OF, thresholds))
    assert Counter((r.verdict, r.decision) for r in rows.values()) == {
        ("NOT_TRUSTED", "REFER_TO_HUMAN"): 22, ("TRUSTED", "APPROVE"): 15,
        ("TRUSTED", "DECLINE"): 12, ("TRUSTED", "REFER_TO_HUMAN"): 11}
    assert Counter(tuple(r.blocking_failures) for r in rows.values()) == {
        (): 38, ("LIABILITY_FEED_STALENESS",): 19, ("INCOME_COMPLETENESS",): 1, ("LIABILITY_UNIQUENESS",): 1,
        ("LIABILITY_FEED_STALENESS", "INCOME_COMPLETENESS"): 1}
    expected = {
        "APP-10042": ("NOT_TRUSTED", "REFER_TO_HUMAN", D("31.97"), 0),
        "APP-10002": ("TRUSTED", "REFER_TO_HUMAN", D("24.50"), 2),
        "APP-10023": ("NOT_TRUSTED", "REFER_TO_HUMAN", None, 1),
        "APP-10005": ("TRUSTED", "DECLINE", D("79.17"), 3),
        "APP-10011": ("TRUSTED", "APPROVE", D("18.85"), 1),
        "APP-10030": ("NOT_TRUSTED", "REFER_TO_HUMAN", D("73.49"), 2),
        "APP-10001": ("NOT_TRUSTED", "REFER_TO_HUMAN", D("13.68"), 3),
        "APP-10051": ("NOT_TRUSTED", "REFER_TO_HUMAN", None, 1),
    }
    assert {k: (rows[k].verdict, rows[k].decision, rows[k].dti_pct, rows[k].missed_payments_12m)
            for k in expected} == expected
    assert rows["APP-10042"].decision_reason == (
        'Referred without a credit assessment: blocking trust signal(s) ["LIABILITY_FEED_STALENESS"]. '
        "Oldest contributing record is 42 days old and 97.00% of outstanding exposure comes from a failed feed. "
        "Credit policy was not applied.")
    assert rows["APP-10042"].trust_detail.pct_exposure_from_stale_feeds == D("97.27")


def test_semantic_example(lending):
    names = ["outstanding_exposure", "monthly_obligations", "worst_staleness_days", "stale_exposure",
             "verified_annual_income", "missed_payments"]
    rows = LENDING.query(dict(lending.items()), ["applicant_id", "applicant_name"], names, AS_OF,
                         "applicant_id = 'APP-10042'").collect()
    assert [tuple(r) for r in rows] == [
        ("APP-10042", "Marcus Webb", D("421500.00"), D("3410.00"), 42, D("410000.00"), D("128000.00"), 0)]


def test_lineage_of_the_worked_example(lending, rounds):
    lines = au.source_lineage(rounds.first.audit, rounds.first.sources, lending.liabilities)
    got = [(r.liability_record_id, r.supplying_feed, r.record_age_days_at_decision, r.record_breached_freshness,
            r.pct_of_total_exposure)
           for r in lines.filter("applicant_id = 'APP-10042'").orderBy("liability_record_id").collect()]
    assert got == [("LIA-80042", "BUREAU_TU", 42, True, D("97.27")), ("LIA-80043", "BUREAU_EQ", 0, False, D("2.73"))]
    total = lines.groupBy("decision_id").agg(F.sum("outstanding_balance").alias("s"))
    off = total.join(rounds.first.audit, "decision_id").filter("s <> outstanding_exposure")
    assert off.count() == 0


def test_after_the_late_batch(rounds, thresholds):
    assert rounds.sources_now.liabilities.count() == 168
    after = rounds.second.audit
    assert Counter((r.trust_verdict, r.decision) for r in after.select("trust_verdict", "decision").collect()) == {
        ("NOT_TRUSTED", "REFER_TO_HUMAN"): 3, ("TRUSTED", "APPROVE"): 23, ("TRUSTED", "DECLINE"): 20,
        ("TRUSTED", "REFER_TO_HUMAN"): 14}
    r = after.filter("applicant_id = 'APP-10042'").first()
    assert (r.outstanding_exposure, r.monthly_obligations, r.dti_pct, r.risk_tier, r.decision) == (
        D("493800.00"), D("5350.00"), D("50.16"), "TIER_4_HIGH", "DECLINE")
    now = profile.credit_profile(rounds.sources_now, "2024-03-01 23:45:00", thresholds)
    drifted = au.drift(rounds.audit(), now).filter("applicant_id = 'APP-10042'").orderBy("decided_at").collect()
    assert drifted[0].exposure_change == D("72300.00") and drifted[0].dti_change == D("18.19")
    assert drifted[0].drift_finding.startswith("UNDERSTATED AT DECISION") and drifted[0].tier_changed
    assert drifted[1].drift_finding.startswith("STABLE")
    outcomes = dashboard.three_outcomes(rounds.audit(), now)
    o = outcomes.filter("applicant_id = 'APP-10042'").first()
    assert (o.without_trust_signal, o.with_trust_gate, o.once_recovered, o.gate_changed_outcome) == (
        "APPROVE", "REFER_TO_HUMAN", "DECLINE", True)


def test_invariants(rounds):
    a = rounds.audit()
    assert a.filter("trust_verdict = 'NOT_TRUSTED' AND decision <> 'REFER_TO_HUMAN'").count() == 0
    assert a.select("decision_id").distinct().count() == a.count() == 120
    assert a.filter(F.length("decision_id") > 60).count() == 0
