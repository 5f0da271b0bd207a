"""Figures behind the reviewer's screens, aggregated before they reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.functions.rules import counterfactual
from surety.model import TOTAL
from surety.operators.audit import drift


def kpis(feeds: DataFrame, audit: DataFrame) -> DataFrame:
    """One row: failing feeds, worst age, blocked decisions, records on failing feeds."""
    failing = F.col("trust_status") == "FAIL"
    feed_side = feeds.agg(
        F.count_if(failing).alias("failing_feeds"),
        F.count(F.lit(1)).alias("total_feeds"),
        F.max("staleness_days").alias("worst_staleness_days"),
        F.coalesce(F.sum(F.when(failing, F.col("record_count"))), F.lit(0)).alias("records_on_failing_feeds"),
    )
    decided = audit.agg(
        F.count_if(F.col("trust_verdict") == "NOT_TRUSTED").alias("blocked_decisions"),
        F.count(F.lit(1)).alias("total_decisions"),
    )
    return feed_side.select(
        "*",
        decided.select("blocked_decisions").scalar().alias("blocked_decisions"),
        decided.select("total_decisions").scalar().alias("total_decisions"),
    )


def outcome_columns() -> tuple:
    """Audit columns that :func:`three_outcomes_of` needs beside the drift."""
    return ("missed_payments_12m", "worst_staleness_days",
            F.to_json("trust_detail.blocking_failures").alias("blocking_failures"))


def three_outcomes(audit: DataFrame, profile: DataFrame) -> DataFrame:
    return three_outcomes_of(drift(audit, profile, carry=outcome_columns()))


def three_outcomes_of(rows: DataFrame) -> DataFrame:
    """Per entity: what policy alone would have said, what the gate said, what was said last.

    First and latest are picked by aggregates that combine on the map side, so
    an entity with very many decisions needs no sort of its own.
    """
    order = F.struct("decided_at", "decision_id")
    picked = rows.groupBy("applicant_id").agg(
        F.min_by(F.struct(
            "dti_at_decision", "exposure_at_decision", "missed_payments_12m", "decision_taken",
            "trust_at_decision", "worst_staleness_days", "blocking_failures"), order).alias("first"),
        F.max_by(F.struct("decision_taken", "dti_now", "exposure_now"), order).alias("latest"),
        F.count(F.lit(1)).alias("decision_count"),
    )
    without = counterfactual(F.col("first.dti_at_decision"), F.col("first.missed_payments_12m"))
    return picked.select(
        "applicant_id",
        without.alias("without_trust_signal"),
        F.col("first.dti_at_decision").alias("first_dti"),
        F.col("first.exposure_at_decision").alias("first_exposure"),
        F.col("first.decision_taken").alias("with_trust_gate"),
        F.col("first.trust_at_decision").alias("first_trust_verdict"),
        F.col("first.worst_staleness_days").alias("first_worst_staleness_days"),
        F.col("first.blocking_failures").alias("first_blocking_failures"),
        F.col("latest.decision_taken").alias("once_recovered"),
        F.col("latest.dti_now").alias("latest_dti"),
        F.col("latest.exposure_now").alias("latest_exposure"),
        "decision_count",
        ((without != F.col("latest.decision_taken")) & (F.col("decision_count") > 1))
        .alias("gate_changed_outcome"),
    )


def breach_summary(lineage: DataFrame) -> DataFrame:
    """Per decision: records that had breached freshness, and their share of exposure."""
    breached = F.col("record_breached_freshness")
    return lineage.groupBy("decision_id", "applicant_id").agg(
        F.count_if(breached).alias("breached_records"),
        F.count(F.lit(1)).alias("total_records"),
        F.coalesce(F.sum(F.when(breached, F.col("pct_of_total_exposure"))), F.lit(0))
        .cast(TOTAL).alias("breached_pct_of_exposure"),
    )


def exposure_by_feed(lineage: DataFrame) -> DataFrame:
    return lineage.groupBy("decision_id", "applicant_id", "supplying_feed").agg(
        F.sum("outstanding_balance").cast(TOTAL).alias("outstanding_balance"),
        F.count(F.lit(1)).alias("record_count"),
    )


def understated(drifted: DataFrame) -> DataFrame:
    return drifted.filter(F.col("drift_finding").startswith("UNDERSTATED")).agg(
        F.count(F.lit(1)).alias("understated_decisions"), F.max("dti_change").alias("largest_dti_gap"))


def dti_long(drifted: DataFrame) -> DataFrame:
    """Then and now as rows, missing ratios left out."""
    return (
        drifted.select("decision_id", "applicant_id", "decided_at",
                       F.col("dti_at_decision").alias("At decision"), F.col("dti_now").alias("Today"))
        .unpivot(["decision_id", "applicant_id", "decided_at"], ["At decision", "Today"], "measured", "dti")
        .filter(F.col("dti").isNotNull())
    )
