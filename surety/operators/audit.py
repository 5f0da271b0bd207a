"""Reading decision records back: trail, lineage, trust at the time, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.clock import day_age
from surety.functions.money import share
from surety.operators.decide import trust_snapshot

BREACH_DAYS = 7  # at or above

# --- Fixed values: wording of the findings ----------------------------------
HOW_GATED = "Trust gate stopped the assessment -- credit policy never ran"
HOW_POLICY = "Credit policy applied to trusted data"
DEFENSIBLE_REFERRED = "DEFENSIBLE -- untrusted data was referred, not acted on"
NOT_DEFENSIBLE = "NOT DEFENSIBLE -- an automated outcome was issued on untrusted data"
REVIEW_OLD = "REVIEW -- trust passed but contributing records were older than the freshness threshold"
DEFENSIBLE_TRUSTED = "DEFENSIBLE -- trusted data, policy applied"
DRIFT_NONE = "INCOMPARABLE"
DRIFT_STABLE = "STABLE -- figures unchanged since the decision"
DRIFT_UNDER = "UNDERSTATED AT DECISION -- the applicant was riskier than the data showed"
DRIFT_OVER = "OVERSTATED AT DECISION -- the applicant was safer than the data showed"
# --- End of fixed values ----------------------------------------------------


def audit_trail(audit: DataFrame, applicants: DataFrame) -> DataFrame:
    """One row per decision, readable by a reviewer, with whether it was defensible."""
    gated = F.col("trust_verdict") == "NOT_TRUSTED"
    names = applicants.select("applicant_id", F.col("full_name").alias("applicant_name"))
    return audit.join(names, "applicant_id", "left").select(
        "decision_id", "decided_at", "decided_by", "applicant_id", "application_id", "applicant_name",
        "decision", "trust_verdict",
        F.when(gated, HOW_GATED).otherwise(HOW_POLICY).alias("how_outcome_was_reached"),
        "decision_reason", "policy_version",
        "gross_annual_income", "outstanding_exposure", "monthly_obligations", "dti_pct", "risk_tier",
        "missed_payments_12m", "worst_staleness_days", "pct_exposure_stale",
        F.to_json("trust_detail.blocking_failures").alias("blocking_failures"),
        F.to_json("trust_detail.stale_feeds").alias("stale_feeds_at_decision"),
        "source_feeds_used", "source_record_ids",
        F.when(gated & (F.col("decision") == "REFER_TO_HUMAN"), DEFENSIBLE_REFERRED)
        .when(gated & (F.col("decision") != "REFER_TO_HUMAN"), NOT_DEFENSIBLE)
        .when(F.col("worst_staleness_days") >= BREACH_DAYS, REVIEW_OLD)
        .otherwise(DEFENSIBLE_TRUSTED).alias("audit_assessment"),
    )


def newest_decisions(audit: DataFrame, n: int) -> DataFrame:
    """The ``n`` latest decisions, newest first; ties by decision id. A top-k, so no total sort."""
    return audit.orderBy(F.desc("decided_at"), "decision_id").limit(n)


def largest_records(lineage: DataFrame, n: int) -> DataFrame:
    """The ``n`` lineage rows of the largest balance; ties by decision and record id."""
    return lineage.orderBy(F.desc_nulls_last("outstanding_balance"), "decision_id", "liability_record_id").limit(n)


def blocked_only(trail: DataFrame) -> DataFrame:
    return trail.filter(F.col("trust_verdict") == "NOT_TRUSTED")


def recorded_ids(sources: DataFrame) -> DataFrame:
    """The ids of the liability records behind each decision, one a row and all of them."""
    return sources.select(
        "decision_id", "decided_at", "applicant_id", F.col("liability_id").alias("liability_record_id"))


def source_lineage(
    audit: DataFrame, sources: DataFrame, liabilities: DataFrame | None = None
) -> DataFrame:
    """One row per liability record behind each decision, with its age at the time.

    With ``liabilities`` the recorded ids are resolved against that table as it
    reads now; without, against the version kept with the decision, which
    needs no join to the facts at all.
    """
    details = ("liability_type", "creditor_name", "outstanding_balance", "monthly_payment",
               "source_system", "effective_date", "loaded_at")
    if liabilities is None:
        records = sources.select("decision_id", "liability_id", *details)
    else:
        records = sources.select("decision_id", "liability_id").join(
            liabilities.select("liability_id", *details), "liability_id", "left")
    decided = audit.select(
        "decision_id", "decided_at", "applicant_id", "decision", "trust_verdict", "outstanding_exposure")
    age = day_age(F.col("loaded_at"), F.col("decided_at"))
    return records.join(decided, "decision_id").select(
        "decision_id", "decided_at", "applicant_id", "decision", "trust_verdict",
        F.col("liability_id").alias("liability_record_id"),
        "liability_type", "creditor_name", "outstanding_balance", "monthly_payment",
        F.col("source_system").alias("supplying_feed"),
        F.col("effective_date").alias("balance_as_of"),
        F.col("loaded_at").alias("record_loaded_at"),
        age.alias("record_age_days_at_decision"),
        F.coalesce(age >= BREACH_DAYS, F.lit(False)).alias("record_breached_freshness"),
        share(F.col("outstanding_balance"), F.col("outstanding_exposure")).alias("pct_of_total_exposure"),
    )


def trust_at_decision(snapshot: DataFrame, audit: DataFrame) -> DataFrame:
    """Frozen signals with the outcome beside them, from a snapshot kept as a table.

    Where the snapshot is only a view over audit and batch, ``frozen_trust``
    gives the same rows without joining the audit twice.
    """
    outcome = audit.select("decision_id", "decision", "trust_verdict")
    return snapshot.drop("snapshot_id").join(outcome, "decision_id", "left")


def frozen_trust(audit: DataFrame, batch: DataFrame) -> DataFrame:
    return trust_snapshot(audit, batch, carry=("decision", "trust_verdict")).drop("snapshot_id")


_THEN = {
    "decision_id": "decision_id", "decided_at": "decided_at", "decision_taken": "decision",
    "trust_at_decision": "trust_verdict", "exposure_at_decision": "outstanding_exposure",
    "obligations_at_decision": "monthly_obligations", "dti_at_decision": "dti_pct", "tier_at_decision": "risk_tier",
}
_NOW = {
    "exposure_now": "outstanding_exposure", "obligations_now": "monthly_obligations",
    "dti_now": "dti_pct", "tier_now": "risk_tier",
}


def _named(names: dict[str, str]) -> list[Column]:
    return [F.col(c).alias(n) for n, c in names.items()]


def _changes(rows: DataFrame) -> DataFrame:
    then_dti, now_dti = F.col("dti_at_decision"), F.col("dti_now")
    return rows.withColumns({
        "exposure_change": F.round(F.col("exposure_now") - F.col("exposure_at_decision"), 2),
        "dti_change": F.round(now_dti - then_dti, 2),
        "tier_changed": F.coalesce(F.col("tier_now") != F.col("tier_at_decision"), F.lit(False)),
        "drift_finding": F.when(now_dti.isNull() | then_dti.isNull(), DRIFT_NONE)
        .when(F.abs(now_dti - then_dti) < 0.01, DRIFT_STABLE)
        .when(now_dti > then_dti, DRIFT_UNDER)
        .otherwise(DRIFT_OVER),
    })


def drift(audit: DataFrame, profile: DataFrame, carry: Sequence[str | Column] = ()) -> DataFrame:
    """Figures each decision was made on against what the same applicant shows now.

    ``carry``: further audit columns to keep, for steps that would otherwise
    have to join the audit a second time.
    """
    now = profile.select("applicant_id", *_named(_NOW))
    return _changes(audit.select("applicant_id", *_named(_THEN), *carry).join(now, "applicant_id", "left"))


def drift_of_rounds(first: DataFrame, last: DataFrame, carry: Sequence[str | Column] = ()) -> DataFrame:
    """As :func:`drift`, for two rounds over one population of which the last shows the present.

    The last round's records hold the figures of now, so neither facts nor
    profile are read for them again: one join by applicant, then one row for
    each of the two decisions. Every applicant has one decision a round.
    """
    def packed(audit: DataFrame, name: str) -> DataFrame:
        rows = audit.select("applicant_id", F.struct(*_named(_THEN), *carry).alias(name), F.struct(*_named(_NOW)).alias(f"{name}_now"))
        return rows

    both = packed(first, "first").drop("first_now").join(packed(last, "last"), "applicant_id", "full_outer")
    rows = both.select("applicant_id", F.explode(F.array("first", "last")).alias("r"), F.col("last_now").alias("n")).filter("r is not null")
    return _changes(rows.select("applicant_id", "r.*", "n.*"))
