"""Records as they read at any instant: versions with a time of validity, and joins as of the time of each row.

A version holds from ``valid_from`` (included) to ``valid_to`` (excluded; null: still). A row that asks at the very instant
a version begins sees that version.

The join of rows with the versions valid at their own time is an equi-join on the entity with a condition on time. So that
an entity owning a third of the rows is not met whole against all its decisions, both sides are also cut into bins of
time: a version goes to those of its bins in which its entity asks at all, and rows meet versions of their entity and bin.
A match lies in exactly one bin, that of the asking row, so nothing is found twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from surety.functions.clock import AsOf, day_age, instant
from surety.functions.money import annual_percent, percent, share
from surety.functions.rules import risk_tier
from surety.model import LIABILITY_STALENESS, PERCENT, TOTAL, Sources
from surety.operators import late
from surety.operators.audit import BREACH_DAYS
from surety.operators.exposure import STALE_AFTER_DAYS, fail_limit
from surety.operators.incremental import change_set
from surety.operators.profile import current_income, current_repayment

BIN_DAYS = 30


@dataclass(frozen=True)
class Arrival:
    """A late batch, when it became known, and the feed that caught up with it as a whole, if one did."""

    batch: DataFrame
    at: AsOf
    feed: str | None = None


def versions(known: DataFrame, key: Sequence[str] | str, *, at: str = "valid_from") -> DataFrame:
    """Every row of ``known`` with ``valid_to``: the time of the next row of its key.

    Of several rows of one key and time only one can be the version of that time; the job fails, as which one would depend
    on order. Rows of one key are few (one per change of the record), whatever entity the record belongs to.
    """
    names = [key] if isinstance(key, str) else list(key)
    order = Window.partitionBy(*names).orderBy(at)
    following = F.lead(at).over(order)
    twice = F.concat(F.lit("two versions of one time for key "), F.concat_ws("/", *[F.col(n).cast("string") for n in names]))
    checked = F.when(following == F.col(at), F.raise_error(twice).cast("timestamp")).otherwise(following)
    return known.withColumn("valid_to", checked)


def record_history(facts: DataFrame, loaded: AsOf, arrivals: Sequence[Arrival], key: str = late.KEY) -> DataFrame:
    """All versions of the records: as loaded, and as each late batch left them. Arrivals are given in order of time.

    Each arrival adds only the rows it changes (its change set), found against the state the arrivals before it left.
    Records without a key have the version they were loaded with.
    """
    known, now = facts.withColumn("valid_from", instant(loaded)), facts
    for arrival in arrivals:
        changes = change_set(now, arrival.batch, arrival.feed, arrival.at)
        known = known.unionByName(changes.filter("sign = 1").drop("sign").filter(F.col(key).isNotNull()).withColumn(
            "valid_from", instant(arrival.at)))
        now = late.merge_late(now, arrival.batch)
        if arrival.feed is not None:
            now = late.feed_catch_up(now, arrival.feed, arrival.at)
    keyed = versions(known.filter(F.col(key).isNotNull()), key)
    return keyed.unionByName(known.filter(F.col(key).isNull()).withColumn("valid_to", F.lit(None).cast("timestamp")))


def as_of(history: DataFrame, when: AsOf) -> DataFrame:
    """The table as it read at one instant; the filter reaches the scan of a stored history."""
    t = instant(when)
    holds = (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))
    return history.filter(holds).drop("valid_from", "valid_to")


def _bin(t: Column, days: int) -> Column:
    return F.floor(F.unix_timestamp(t) / (86400 * days))


def as_of_join(rows: DataFrame, history: DataFrame, entity: str, at: str, bin_days: int = BIN_DAYS) -> DataFrame:
    """Each of ``rows`` beside the versions of its entity that were valid at its own time ``at`` (inner join).

    Columns of ``history`` other than the entity must not occur in ``rows``. Rows without an entity or a time match nothing.
    """
    asking = rows.withColumn("_bin", _bin(F.col(at), bin_days))
    # one row per entity that asks, with the bins it asks in: as many as its timeline has, however often it asks in each
    bins = asking.groupBy(entity).agg(F.collect_set("_bin").alias("_bins"))
    first, last = _bin(F.col("valid_from"), bin_days), _bin(F.col("valid_to"), bin_days)
    covered = F.filter("_bins", lambda b: (b >= first) & (last.isNull() | (b <= last)))
    cut = history.join(bins, entity).withColumn("_bin", F.explode(covered)).drop("_bins")
    holds = (F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col(at)))
    return asking.join(cut, [entity, "_bin"]).filter(holds).drop("_bin")


def lineage_as_of(audit: DataFrame, history: DataFrame, bin_days: int = BIN_DAYS) -> DataFrame:
    """One row per liability record behind each decision, as the record read when the decision was made.

    ``audit``: decision records of any number of rounds, each row with its own ``decided_at``.
    """
    asked = audit.select("decision_id", "decided_at", "applicant_id", "decision", "trust_verdict", "outstanding_exposure")
    age = day_age(F.col("loaded_at"), F.col("decided_at"))
    return as_of_join(asked, history, "applicant_id", "decided_at", bin_days).select(
        "decision_id", "decided_at", "applicant_id", "decision", "trust_verdict",
        F.col("liability_id").alias("liability_record_id"), "liability_type", "creditor_name", "outstanding_balance",
        "monthly_payment", F.col("source_system").alias("supplying_feed"), F.col("effective_date").alias("balance_as_of"),
        F.col("loaded_at").alias("record_loaded_at"), F.col("valid_from").alias("version_from"),
        F.col("valid_to").alias("version_to"), age.alias("record_age_days_at_decision"),
        F.coalesce(age >= BREACH_DAYS, F.lit(False)).alias("record_breached_freshness"),
        share(F.col("outstanding_balance"), F.col("outstanding_exposure")).alias("pct_of_total_exposure"),
    )


def profile_as_of(
    audit: DataFrame, history: DataFrame, sources: Sources, thresholds: DataFrame, bin_days: int = BIN_DAYS
) -> DataFrame:
    """The figures behind each decision worked out again from the records of its time, beside the recorded ones.

    ``replays``: whether exposure, obligations, ratio and tier come out as recorded. Decisions on entities without a
    liability have no figures, and replay if none were recorded. Income and repayment are taken from ``sources``, as
    these tables have no late batches.
    """
    asked = audit.select(
        "decision_id", "decided_at", "applicant_id", *[F.col(c).alias(f"recorded_{c}") for c in _FIGURES])
    met = as_of_join(asked.select("decision_id", "decided_at", "applicant_id"), history, "applicant_id", "decided_at", bin_days)
    age = day_age(F.col("loaded_at"), F.col("decided_at"))
    balance, zero = F.col("outstanding_balance"), F.lit(0).cast("decimal(12,2)")
    # the decision is one of many of its entity, so a hot entity is spread; sums combine before they are moved
    figures = met.groupBy("decision_id").agg(
        F.sum(balance).cast(TOTAL).alias("outstanding_exposure"), F.sum("monthly_payment").cast(TOTAL).alias("monthly_obligations"),
        F.count(F.lit(1)).alias("liability_count"), F.max(age).alias("worst_staleness_days"),
        F.sum(F.when(age > STALE_AFTER_DAYS, balance).otherwise(zero)).cast(TOTAL).alias("_stale"),
        F.sum(F.when(age >= fail_limit(thresholds, LIABILITY_STALENESS), balance).otherwise(zero)).cast(TOTAL).alias("_failed"))
    income = current_income(sources.income).select("applicant_id", "gross_annual_income")
    missed = current_repayment(sources.repayment).select("applicant_id", "missed_payments_12m")
    rows = (
        asked.join(figures, "decision_id", "left").join(income, "applicant_id", "left").join(missed, "applicant_id", "left")
        .withColumn("dti_pct", annual_percent(F.col("monthly_obligations"), F.col("gross_annual_income")))
        .withColumn("risk_tier", risk_tier(F.col("gross_annual_income"), F.col("monthly_obligations"), F.col("dti_pct"), F.col("missed_payments_12m")))
        .withColumns({"worst_staleness_days": F.coalesce(F.col("worst_staleness_days"), F.lit(0)),
                      "liability_count": F.coalesce(F.col("liability_count"), F.lit(0)),
                      "pct_exposure_from_stale_feeds": F.coalesce(percent(F.col("_stale"), F.col("outstanding_exposure")), F.lit(0).cast(PERCENT)),
                      "pct_exposure_from_failed_records": F.coalesce(share(F.col("_failed"), F.col("outstanding_exposure")), F.lit(0).cast(PERCENT))})
    )
    same = F.lit(True)
    for c in _FIGURES:
        same = same & F.col(c).eqNullSafe(F.col(f"recorded_{c}"))
    return rows.select("decision_id", "decided_at", "applicant_id", *_FIGURES, "liability_count", "worst_staleness_days",
                       "pct_exposure_from_stale_feeds", "pct_exposure_from_failed_records",
                       *[f"recorded_{c}" for c in _FIGURES], same.alias("replays"))


_FIGURES = ("outstanding_exposure", "monthly_obligations", "dti_pct", "risk_tier")
