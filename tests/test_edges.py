"""Cases the published figures do not reach."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF
from surety.functions.clock import hours_before
from surety.model import PARTNER_SIGNALS, literal_rows, no_partner_signals, seed_thresholds
from surety.operators import audit as au
from surety.operators import decide, late, profile, signals, tags, trust
from surety.operators.exposure import content_duplicates, exposure
from surety.plans.assess import assess
from surety.plans.semantic import LENDING
from test_boundaries import debt


def test_debt_free_entity_falls_through_to_decline(make, thresholds):
    row = decide.decisions(make([], repayments=()), AS_OF, thresholds).first()
    assert (row.verdict, row.decision, row.dti_pct, row.risk_tier) == ("TRUSTED", "DECLINE", None, "TIER_UNKNOWN")
    assert "DTI 0.00% with 0 missed" in row.decision_reason and row.policy_note.startswith("DTI_UNDEFINED")
    assert row.worst_staleness_days == 0 and row.stale_feeds == []


def test_zero_income_is_no_division_error(make, thresholds):
    row = profile.credit_profile(make([debt("d", 1)], incomes=[("A", "0")]), AS_OF, thresholds).first()
    assert row.dti_pct is None and row.risk_tier == "TIER_UNKNOWN"


def test_zero_balances_have_no_stale_share(make, thresholds):
    src = make([debt("d", 300, "0.00")])
    row = profile.credit_profile(src, AS_OF, thresholds).first()
    assert row.pct_exposure_from_stale_feeds == D("0.00")
    v = trust.entity_trust(src, AS_OF, thresholds).first()
    assert v.stale_feeds == ["TU"] and v.pct_exposure_from_stale_feeds == D("0.00")


def test_second_side_record_does_not_multiply_rows(make, thresholds):
    src = make([debt("d", 1)], incomes=[("A", "10000", 9), ("A", "60000", 2), ("A", None, 30)])
    rows = profile.credit_profile(src, AS_OF, thresholds).collect()
    assert len(rows) == 1 and rows[0].gross_annual_income == D("60000.00")
    assert not trust.entity_trust(src, AS_OF, thresholds).first().income_missing


def test_very_large_ratio_is_kept(make, thresholds):
    src = make([debt("d", 1, payment="999999.00")], incomes=[("A", "1.00")])
    made = assess(src, "X", AS_OF, thresholds)
    assert made.audit.first().dti_pct == D("1199998800.00")


def test_content_key_is_a_parameter(make):
    src = make([debt("1", 1), debt("2", 1), debt("3", 1, "5.00"), debt("4", 1, kind="MORTGAGE")])
    facts = src.liabilities.withColumn("creditor_name", F.concat(F.lit("L"), "liability_id"))
    assert content_duplicates(facts).first().duplicate_groups == 1
    keys = ("liability_type", "outstanding_balance", "creditor_name")
    assert content_duplicates(facts, keys).count() == 0


def test_missing_content_values_count_as_equal(make):
    src = make([debt("1", 1, None), debt("2", 1, None)])
    assert content_duplicates(src.liabilities).first().duplicate_groups == 1


def test_unknown_applicants_are_rejected(spark, make, thresholds):
    src = make([debt("d", 1)], applicants="AB", incomes=[("A", "60000"), ("B", "60000")])
    asked = spark.createDataFrame([("A",), ("nobody",)], "applicant_id string")
    made = assess(src, "X", AS_OF, thresholds, population=asked)
    assert [r.applicant_id for r in made.audit.collect()] == ["A"]
    assert [(r.applicant_id, r.reason) for r in made.rejects.collect()] == [("nobody", "UNKNOWN_APPLICANT")]
    assert made.snapshot().select("applicant_id").distinct().count() == 1


def test_a_population_meets_the_applicants_only(spark, make, thresholds):
    """The list of a population may be longer than every table; it is joined, and so sorted, once."""
    src = make([debt("d", 1), debt("e", 1, applicant="B"), debt("f", 1, applicant="C")], applicants="ABC",
               incomes=[("A", "60000"), ("B", "60000"), ("C", "60000")])
    asked = spark.createDataFrame([("A",), ("C",), ("C",), (None,), ("nobody",)], "applicant_id string")
    made = assess(src, "X", AS_OF, thresholds, population=asked)
    whole = assess(src, "X", AS_OF, thresholds)
    assert made.audit._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 1
    own = F.col("applicant_id").isin("A", "C")
    for got, want in ((made.audit, whole.audit), (made.sources, whole.sources)):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.filter(own).collect()))


def _partner(spark, rows):
    return literal_rows(spark, [
        (f"S{n}", scope, "F", record, name, "ACCURACY", 1, index, status, blocking, None, "d")
        for n, (scope, record, name, index, status, blocking) in enumerate(rows)], PARTNER_SIGNALS)


def test_partner_rows_matching_twice_count_once(spark, make, thresholds, by):
    src = make([debt("1", 1), debt("2", 1, applicant="B")], incomes=[("A", "60000"), ("B", "60000")], applicants="AB")
    partner = _partner(spark, [
        ("RAW.LIABILITIES", "A", "R1", 50, "FAIL", True),     # table-wide, names A as well
        ("RAW.APPLICANTS", "A", "R1", 40, "FAIL", True),      # A only
        ("RAW.APPLICANTS", "A", "R2", 60, "FAIL", False),     # not blocking
        (None, "B", "R3", 10, "FAIL", True),                  # B, no scope
        ("RAW.APPLICANTS", None, "R4", 1, "FAIL", True),      # nobody
        ("RAW.LIABILITIES", None, "R5", 70, "PASS", True),    # passes
    ])
    got = by(trust.entity_trust(src, AS_OF, thresholds, partner))
    pairs = {k: [tuple(p) for p in v.partner_blocking_failures] for k, v in got.items()}
    assert pairs == {"A": [("R1", 2)], "B": [("R1", 1), ("R3", 1)]}
    assert {k: v.partner_trust_index for k, v in got.items()} == {"A": D("40.00"), "B": D("10.00")}
    assert {v.verdict for v in got.values()} == {"TRUSTED"}
    strict = by(trust.entity_trust(src, AS_OF, thresholds, partner, strict=True))
    assert strict["B"].blocking_failures == ["PARTNER_SIGNAL"]


def test_empty_partner_table_changes_nothing(spark, lending, thresholds):
    without = trust.entity_trust(lending, AS_OF, thresholds)
    with_empty = trust.entity_trust(lending, AS_OF, thresholds, no_partner_signals(spark))
    assert without.exceptAll(with_empty).count() == 0
    feeds = signals.feed_trust(signals.scoped(lending), AS_OF, thresholds)
    assert signals.unified_signals(feeds, no_partner_signals(spark)).count() == feeds.count() == 5
    assert len(signals.unified_signals(feeds).columns) == 13


def test_strict_blocks_on_other_feeds(make, thresholds):
    src = make([debt("d", 1)], incomes=[("A", "60000", 14 * 24)])
    assert trust.entity_trust(src, AS_OF, thresholds).first().verdict == "TRUSTED"
    assert trust.entity_trust(src, AS_OF, thresholds, strict=True).first().blocking_failures == [
        "INCOME_FEED_STALENESS"]


def test_ungoverned_feed_is_not_passing(spark, make):
    none = seed_thresholds(spark, [])
    loads = signals.feed_loads({"RAW.OTHER": make([debt("d", 1)]).liabilities})
    graded = signals.grade_feeds(loads, AS_OF, none)
    assert graded.first().trust_status == "UNGOVERNED"
    row = signals.unified_signals(graded).first()
    assert row.signal_name == "LIABILITY_FEED_STALENESS" and row.is_blocking is False


def test_two_rules_for_one_scope_give_two_rows(spark, make):
    rows = [(n, "TIMELINESS", "RAW.LIABILITIES", 3, 7, "days", True, "T", "r") for n in ("R1", "R2")]
    loads = signals.feed_loads({"RAW.LIABILITIES": make([debt("d", 1)]).liabilities})
    assert signals.grade_feeds(loads, AS_OF, seed_thresholds(spark, rows)).count() == 2


def test_merge_twice_is_merge_once(lending, rounds):
    once = rounds.sources_now.liabilities
    batch = once.filter(F.col("liability_id").isin("LIA-80042", "LIA-80044", "LIA-80045"))
    assert late.merge_late(once, batch).exceptAll(once).count() == 0
    assert late.merge_late(once, batch).count() == once.count()


def test_merge_takes_only_the_refreshed_columns(make):
    facts = make([debt("1", 500, "10.00"), debt("2", 500, "20.00")]).liabilities
    batch = make([debt("1", 2, None, kind="CHANGED", feed="X", payment="7.00"), debt("9", 2)]).liabilities
    got = {r.liability_id: r for r in late.merge_late(facts, batch).collect()}
    assert set(got) == {"1", "2", "9"}
    assert (got["1"].outstanding_balance, got["1"].monthly_payment) == (None, D("7.00"))
    assert (got["1"].liability_type, got["1"].source_system) == ("AUTO_LOAN", "TU")


def test_doubled_batch_key_fails_the_merge(make):
    facts = make([debt("1", 500)]).liabilities
    batch = make([debt("2", 2), debt("2", 3)]).liabilities
    with pytest.raises(Exception, match="more than one row for liability_id 2"):
        late.merge_late(facts, batch).select("applicant_id").collect()


def test_catch_up_leaves_other_rows_alone(make):
    facts = make([debt("1", 500), debt("2", 500, feed="EQ"), debt("3", 24)]).liabilities
    got = {r.liability_id: r.loaded_at for r in late.feed_catch_up(facts, "TU", AS_OF).collect()}
    was = {r.liability_id: r.loaded_at for r in facts.collect()}
    assert got["2"] == was["2"] and got["3"] == was["3"] and got["1"] != was["1"]


def test_semantic_keeps_entities_without_children_and_orphans(make):
    src = make([debt("1", 1), debt("2", 1, "7.00", applicant="ghost")], applicants="AB", repayments=())
    data = dict(src.items())
    rows = {r.applicant_id: r for r in LENDING.query(
        data, ["applicant_id"], ["outstanding_exposure", "income"], AS_OF).collect()}
    assert set(rows) == {"A", "B", None}
    assert rows["B"].outstanding_exposure is None and rows[None].outstanding_exposure == D("7.00")
    assert rows["A"].verified_annual_income == D("60000.00")
    feeds = LENDING.query(data, ["source_feed", "applicant_name"], ["total debt"], AS_OF).collect()
    assert {(r.source_feed, r.applicant_name, r.outstanding_exposure) for r in feeds} == {
        ("TU", "Name A", D("1000.00")), ("TU", None, D("7.00"))}


def test_semantic_refuses_what_would_multiply(lending):
    data = dict(lending.items())
    with pytest.raises(ValueError, match="cannot group a metric of income"):
        LENDING.query(data, ["liability_type"], ["verified_annual_income"], AS_OF)
    with pytest.raises(KeyError):
        LENDING.query(data, ["applicant_id"], ["no such thing"], AS_OF)
    with pytest.raises(ValueError):
        LENDING.query(data, ["total debt"], [], AS_OF)
    assert LENDING.resolve("Total Debt") is LENDING.resolve("liabilities.outstanding_exposure")
    kinds = [k for k, *_ in LENDING.describe()]
    assert [kinds.count(k) for k in ("table", "fact", "dimension", "metric")] == [4, 5, 7, 6]


def test_drift_findings(make, thresholds):
    src = make([debt("1", 1)], applicants="ABCD", incomes=[(a, "60000") for a in "ABCD"])
    profile_now = profile.credit_profile(src, AS_OF, thresholds)
    audit = assess(src, "X", AS_OF, thresholds).audit
    changed = audit.withColumn("dti_pct", F.when(F.col("applicant_id") == "A", F.lit("0.15").cast("decimal(18,2)")))
    got = {r.applicant_id: r for r in au.drift(changed, profile_now).collect()}
    assert got["A"].drift_finding.startswith("UNDERSTATED") and got["B"].drift_finding == "INCOMPARABLE"
    assert got["B"].tier_changed is False


def test_issued_on_untrusted_data_is_not_defensible(make, thresholds):
    src = make([debt("1", 500)])
    audit = assess(src, "X", AS_OF, thresholds).audit.withColumn("decision", F.lit("APPROVE"))
    assert au.audit_trail(audit, src.applicants).first().audit_assessment.startswith("NOT DEFENSIBLE")


def test_tags(spark):
    rows = spark.createDataFrame(
        [("t1", "CREDIT_RISK", "CERTIFIED", "TRUE"), ("t2", "SERVICING", "UNCERTIFIED", "TRUE"),
         ("v", "NONSENSE", "CERTIFIED", "TRUE")],
        "object_name string, data_domain string, trust_tier string, decision_critical string")
    edges = spark.createDataFrame([("v", "t1"), ("v", "t2")], "object_name string, input_object string")
    got = {r.object_name: r for r in tags.inherited_tiers(rows, edges).collect()}
    assert got["v"].inherited_tier == "UNCERTIFIED" and not got["v"].tier_consistent and not got["v"].values_allowed
    assert got["t1"].inherited_tier == "CERTIFIED" and got["t1"].tier_consistent


def test_exposure_against_brute_force(lending, thresholds):
    """The two-step grouping against plain Python over the same rows."""
    rows = lending.liabilities.collect()
    got = {r.applicant_id: r for r in exposure(lending.liabilities, AS_OF, thresholds).collect()}
    assert set(got) == {r.applicant_id for r in rows}
    for who, g in got.items():
        mine = [r for r in rows if r.applicant_id == who]
        assert g.outstanding_exposure == sum(r.outstanding_balance for r in mine)
        assert g.liability_count == len(mine)
        assert g.liability_feeds_used == sorted({r.source_system for r in mine})
        assert g.oldest_liability_loaded_at == min(r.loaded_at for r in mine)


def test_offsets(spark):
    row = spark.range(1).select(hours_before(AS_OF, F.lit(25)).alias("t")).first()
    assert str(row.t) == "2024-02-29 22:30:00"
