"""Trust gate, credit policy, reasons, and the records a decision leaves behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.clock import AsOf, instant
from surety.functions.ids import stable_id
from surety.functions.rules import policy_outcome
from surety.model import MEASURE, PERCENT, SCOPES, Sources
from surety.operators.incremental import Maintained
from surety.operators.profile import entity_state
from surety.operators.trust import with_verdict

POLICY_VERSION = "v1.0"

# --- Fixed values: wording of the recorded reasons --------------------------
REASON_GATED = (
    "Referred without a credit assessment: blocking trust signal(s) %s. Oldest contributing record "
    "is %s days old and %s%% of outstanding exposure comes from a failed feed. "
    "Credit policy was not applied."
)
REASON_APPROVED = (
    "Approved under policy v1.0: DTI %s%% below the 40%% limit with %s missed payments. "
    "Trust checks passed; oldest contributing record %s days old."
)
REASON_REVIEW = (
    "Referred under policy v1.0: DTI %s%% sits in the 40-50%% review band. Trust checks passed."
)
REASON_DECLINED = (
    "Declined under policy v1.0: DTI %s%% with %s missed payments exceeds policy limits. "
    "Trust checks passed."
)
# --- End of fixed values ----------------------------------------------------


def _text(c: Column) -> Column:
    return c.cast("string")


def decisions(
    sources: Sources,
    as_of: AsOf,
    thresholds: DataFrame,
    partner: DataFrame | None = None,
    strict: bool = False,
    stale_pct_scale: int = 0,
    kept: Maintained | None = None,
) -> DataFrame:
    """Decide a whole population: one row per applicant with figures, verdict and outcome.

    ``stale_pct_scale``: places kept of the stale share in the record and in
    the reason. The recorded figure is a whole per cent by default; the
    two-place figure stays in ``trust_detail``. ``kept``: rollup and duplicates
    as maintained by change sets; the liabilities are then not read at all.
    """
    rollup, duplicates = (kept.exposure(as_of, thresholds), kept.copies) if kept else (None, None)
    state = entity_state(sources, as_of, thresholds, rollup)
    judged = with_verdict(state, sources, as_of, thresholds, partner, strict, duplicates=duplicates)
    gated = F.col("verdict") == "NOT_TRUSTED"
    dti, missed = F.col("dti_pct"), F.col("missed_payments_12m")
    late = F.coalesce(missed, F.lit(0))
    out = judged.withColumns({
        "decision": F.when(gated, "REFER_TO_HUMAN").otherwise(policy_outcome(dti, missed)),
        "pct_exposure_stale": F.round("pct_exposure_from_failed_records", stale_pct_scale).cast(PERCENT),
    })
    reason = (
        F.when(gated, F.format_string(
            REASON_GATED, F.to_json("blocking_failures"), _text(F.col("worst_staleness_days")),
            _text(F.col("pct_exposure_stale"))))
        .when(F.col("decision") == "APPROVE", F.format_string(
            REASON_APPROVED, _text(dti), _text(late), _text(F.col("worst_staleness_days"))))
        .when(F.col("decision") == "REFER_TO_HUMAN", F.format_string(REASON_REVIEW, _text(dti)))
        .otherwise(F.format_string(
            REASON_DECLINED, _text(F.coalesce(dti, F.lit(0).cast(PERCENT))), _text(late)))
    )
    note = F.when(~gated & dti.isNull(), "DTI_UNDEFINED: policy fell through to DECLINE")
    return out.withColumns({"decision_reason": reason, "policy_note": note})


def trust_batch_id(as_of: AsOf, decided_by: str) -> Column:
    return stable_id("BATCH-", instant(as_of), F.lit(decided_by))


def decision_id(as_of: AsOf, decided_by: str) -> Column:
    return stable_id(
        "DEC-", F.col("applicant_id"), F.col("application_id"), instant(as_of), F.lit(decided_by))


def decision_keys(applicants: DataFrame, as_of: AsOf, decided_by: str) -> DataFrame:
    """Ids and times of the decisions on these applicants, without deciding them."""
    return applicants.select(
        "applicant_id",
        decision_id(as_of, decided_by).alias("decision_id"),
        instant(as_of).alias("decided_at"),
        trust_batch_id(as_of, decided_by).alias("trust_batch_id"),
        F.to_date(instant(as_of)).alias("decision_date"),
    )


def audit_records(decided: DataFrame, as_of: AsOf, decided_by: str) -> DataFrame:
    """The decision record: figures used, verdict, outcome and provenance.

    ``source_record_ids`` names the side records and holds count and digest
    (order-free) of the liability records; the ids themselves are rows of
    :func:`decision_sources`, complete for every decision, so that an entity
    with a billion records still has a small audit row.
    """
    return decided.select(
        decision_id(as_of, decided_by).alias("decision_id"),
        "applicant_id", "application_id",
        instant(as_of).alias("decided_at"),
        F.lit(decided_by).alias("decided_by"),
        "gross_annual_income", "outstanding_exposure", "monthly_obligations",
        "dti_pct", "risk_tier", "missed_payments_12m",
        F.col("verdict").alias("trust_verdict"),
        "trust_detail", "worst_staleness_days", "pct_exposure_stale",
        "decision", "decision_reason",
        F.lit(POLICY_VERSION).alias("policy_version"),
        F.struct(
            F.col("applicant_id").alias("applicant_record"),
            F.col("income_record_id").alias("income_record"),
            F.col("payment_record_id").alias("repayment_record"),
            F.coalesce(F.col("liability_count"), F.lit(0)).alias("liability_record_count"),
            F.coalesce(F.col("liability_digest"), F.lit(0).cast("decimal(38,0)")).alias("liability_record_digest"),
        ).alias("source_record_ids"),
        F.coalesce("liability_feeds_used", F.array().cast("array<string>")).alias("source_feeds_used"),
        "policy_note",
        trust_batch_id(as_of, decided_by).alias("trust_batch_id"),
        F.to_date(instant(as_of)).alias("decision_date"),
    )


def assess_result(audit: DataFrame) -> DataFrame:
    """The short answer handed back to whoever asked for the decision."""
    return audit.select(
        "decision_id", "applicant_id", "decision", F.col("decision_reason").alias("reason"),
        "trust_verdict", "dti_pct", "risk_tier", "outstanding_exposure",
        "worst_staleness_days", "policy_version",
    )


RECORDED_COLUMNS = (
    "liability_id", "liability_type", "creditor_name", "outstanding_balance", "monthly_payment",
    "source_system", "effective_date", "loaded_at",
)


def decision_sources(decided: DataFrame, liabilities: DataFrame) -> DataFrame:
    """One row per liability record behind each decision, as it read at the time.

    ``decided``: audit rows, or just :func:`decision_keys`.

    The facts are the large, possibly skewed side and are not regrouped after
    the join, so adaptive execution may split a hot entity freely.
    """
    keys = decided.select("applicant_id", "decision_id", "decided_at", "trust_batch_id", "decision_date")
    return liabilities.select("applicant_id", *RECORDED_COLUMNS).join(keys, "applicant_id")


def trust_batch(signals: DataFrame, as_of: AsOf, decided_by: str) -> DataFrame:
    """The signals as they stood for one batch of decisions, stored once.

    ``signal_id`` names each signal: the partner's own id where there is one,
    else scope and feed.
    """
    own = F.col("signal_id") if "signal_id" in signals.columns else F.lit(None).cast("string")
    native = F.concat_ws("/", F.lit("NATIVE"), "scope_object", F.coalesce("feed_name", F.lit("-")))
    return signals.select(
        trust_batch_id(as_of, decided_by).alias("trust_batch_id"),
        instant(as_of).alias("captured_at"),
        F.coalesce(own, native).alias("signal_id"),
        "signal_source", "scope_object", "feed_name", "record_identifier", "signal_name",
        "measured_value", "trust_status",
        F.coalesce("is_blocking", F.lit(False)).alias("is_blocking"),
        "detail",
        F.to_date(instant(as_of)).alias("decision_date"),
    )


def _by_rule(signals: DataFrame) -> DataFrame:
    """Assessments of single records as one row per rule and outcome."""
    names = ("scope_object", "feed_name", "signal_name", "trust_status", "is_blocking")
    counted = signals.groupBy("trust_batch_id", "captured_at", "signal_source", *names).agg(F.count(F.lit(1)).alias("n"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in names]
    return counted.select(
        "trust_batch_id", "captured_at", F.concat_ws("/", F.lit("RULE"), *parts).alias("signal_id"), "signal_source", "scope_object",
        "feed_name", F.lit(None).cast("string").alias("record_identifier"), "signal_name", F.col("n").cast(MEASURE).alias("measured_value"),
        "trust_status", "is_blocking", F.format_string("%d assessments of single records.", F.col("n")).alias("detail"))


def trust_snapshot(
    audit: DataFrame, batch: DataFrame, salts: int = 16, carry: Sequence[str] = ()
) -> DataFrame:
    """Every decision beside the signals that bear on it, as frozen for its batch.

    Signals about a feed or a table bear on every decision of the batch: one
    row per feed, repeated under ``salts`` sub-keys of which each decision
    picks one. Signals about a record bear on the decision on that record
    only, and meet it by the record's id, so the result grows with decisions
    and signals, not with their product.

    Assessments of single records in the liabilities' scope count for every
    entity in the verdict, so they bear on every decision too: one row per rule
    and outcome, whose ``measured_value`` is their number. The partner's
    blocking failures of a decision are therefore the sum of its frozen rows.
    """
    keyed = audit.select("decision_id", "applicant_id", "trust_batch_id", *carry)
    about_record = F.col("record_identifier").isNotNull()
    for_everybody = about_record & F.coalesce(F.col("scope_object") == SCOPES["liabilities"], F.lit(False))
    frozen = batch.drop("decision_date")
    wide_signals = frozen.filter(~about_record).unionByName(_by_rule(frozen.filter(for_everybody)))
    spread = wide_signals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    wide = keyed.withColumn(
        "salt", F.pmod(F.xxhash64("decision_id"), F.lit(salts)).cast("int")
    ).join(spread, ["trust_batch_id", "salt"]).drop("salt")
    single = keyed.withColumn("record_identifier", F.col("applicant_id").cast("string")).join(
        frozen.filter(about_record & ~for_everybody), ["trust_batch_id", "record_identifier"])
    return wide.unionByName(single).select(
        stable_id("SNAP-", F.col("decision_id"), F.col("signal_source"), F.col("signal_id")).alias("snapshot_id"),
        "decision_id", "applicant_id", "captured_at", "signal_source", "scope_object", "feed_name",
        "signal_name", "measured_value", "trust_status", "is_blocking", "detail", *carry,
    )
