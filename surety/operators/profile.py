"""Entity credit profile: business figures with their provenance beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.functions.clock import AsOf, day_age
from surety.functions.money import annual_percent, percent
from surety.functions.rules import risk_tier
from surety.model import PERCENT, Sources
from surety.operators.exposure import exposure


def _current(df: DataFrame, record_id: str, figures: dict[str, str], *extra) -> DataFrame:
    """One row per entity: the latest record's figures, whatever the declared key says."""
    latest = F.max_by(F.struct(*figures), F.struct("loaded_at", record_id)).alias("latest")
    return (
        df.groupBy("applicant_id")
        .agg(latest, F.max(record_id).alias(record_id), *extra)
        .select("*", *[F.col(f"latest.{c}").alias(name) for c, name in figures.items()])
        .drop("latest")
    )


def current_income(income: DataFrame) -> DataFrame:
    """The latest known figure; the latest record where no figure is known.

    So the profile has an income exactly where the verdict counts one as known.
    """
    order = F.struct(F.col("gross_annual_income").isNotNull(), "loaded_at", "income_record_id")
    row = F.struct("gross_annual_income", F.col("loaded_at").alias("income_loaded_at"))
    return (
        income.groupBy("applicant_id")
        .agg(F.max_by(row, order).alias("latest"), F.max("income_record_id").alias("income_record_id"),
             F.count("gross_annual_income").alias("known_incomes"))
        .select("applicant_id", "income_record_id", "known_incomes", "latest.*")
    )


def current_repayment(repayment: DataFrame) -> DataFrame:
    return _current(
        repayment, "payment_record_id",
        {"missed_payments_12m": "missed_payments_12m", "max_days_past_due": "max_days_past_due",
         "loaded_at": "repayment_loaded_at"},
    )


def entity_state(
    sources: Sources, as_of: AsOf, thresholds: DataFrame, rollup: DataFrame | None = None
) -> DataFrame:
    """Applicants with everything that profile, verdict and decision draw on.

    ``rollup``: the liabilities' rollup where it is kept (see ``operators.incremental``); else it is computed.

    All sides are reduced to one row per entity before they are joined, on the
    key they were reduced by: the joins add no exchange of their own beyond
    that of the applicants, and cannot multiply rows.
    """
    if rollup is None:
        rollup = exposure(sources.liabilities, as_of, thresholds)
    return (
        sources.applicants
        .join(current_income(sources.income), "applicant_id", "left")
        .join(rollup, "applicant_id", "left")
        .join(current_repayment(sources.repayment), "applicant_id", "left")
        .withColumn("dti_pct", annual_percent(F.col("monthly_obligations"), F.col("gross_annual_income")))
        .withColumn("risk_tier", risk_tier(
            F.col("gross_annual_income"), F.col("monthly_obligations"),
            F.col("dti_pct"), F.col("missed_payments_12m")))
    )


def _zero():
    return F.lit(0).cast(PERCENT)


def project_profile(state: DataFrame, as_of: AsOf) -> DataFrame:
    own = F.col("loaded_at")
    ages = [
        day_age(F.coalesce(F.col(c), own), as_of)
        for c in ("loaded_at", "income_loaded_at", "oldest_liability_loaded_at", "repayment_loaded_at")
    ]
    return state.select(
        "applicant_id", "application_id", "full_name", "employment_status", "application_date",
        "requested_amount", "loan_purpose",
        "gross_annual_income", "outstanding_exposure", "monthly_obligations", "liability_count",
        "dti_pct", "missed_payments_12m", "max_days_past_due", "risk_tier",
        "liability_feeds_used", "oldest_liability_loaded_at", "newest_liability_loaded_at",
        "max_liability_staleness_days", "exposure_from_stale_feeds",
        F.coalesce(percent(F.col("exposure_from_stale_feeds"), F.col("outstanding_exposure")), _zero())
        .alias("pct_exposure_from_stale_feeds"),
        F.greatest(*ages).alias("worst_staleness_days_any_source"),
    )


def credit_profile(sources: Sources, as_of: AsOf, thresholds: DataFrame) -> DataFrame:
    """One row per applicant, 22 columns."""
    return project_profile(entity_state(sources, as_of, thresholds), as_of)


def liability_rollup(liabilities: DataFrame, as_of: AsOf, thresholds: DataFrame) -> DataFrame:
    return exposure(liabilities, as_of, thresholds).select(
        "applicant_id", "outstanding_exposure", "monthly_obligations", "liability_count",
        "liability_feeds_used", "oldest_liability_loaded_at", "newest_liability_loaded_at",
        "max_liability_staleness_days", "exposure_from_stale_feeds",
    )
