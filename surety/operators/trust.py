"""Entity-scoped trust verdict: may a decision rest on these records?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.clock import AsOf, day_age, instant
from surety.functions.money import share
from surety.model import (
    INCOME_COMPLETENESS, INDEX, LIABILITY_STALENESS, LIABILITY_UNIQUENESS, PERCENT, SCOPES, Sources,
)
from surety.operators.exposure import CONTENT_KEYS, content_duplicates, fail_limit
from surety.operators.profile import entity_state

_NO_FAILURES = "array<struct<signal_name:string,occurrences:bigint>>"


def _blocking(signals: DataFrame) -> DataFrame:
    return signals.filter((F.col("trust_status") == "FAIL") & F.col("is_blocking"))


def _as_pairs() -> Column:
    # one entry per rule name with its multiplicity, never one entry per assessed record
    return F.sort_array(F.collect_list(F.struct("signal_name", "occurrences")))


def partner_by_entity(partner: DataFrame) -> DataFrame:
    """Record-level assessments per entity, without those that hold for every entity anyway.

    An assessment counts for an entity if it names the entity's record *or* is
    scoped to the liabilities table. The two sets are kept apart: the first is
    an equi-join, the second a single row, and leaving table-scoped rows out
    of the first means a row that fits both is counted once.
    """
    own = partner.filter(
        F.col("record_identifier").isNotNull()
        & ~F.col("scope_object").eqNullSafe(SCOPES["liabilities"])
    )
    blocking = (F.col("trust_status") == "FAIL") & F.col("is_blocking")
    per_rule = own.groupBy("record_identifier", "signal_name").agg(
        F.min("data_trust_index").alias("data_trust_index"),
        F.count_if(blocking).alias("occurrences"),
    )
    failing = F.when(F.col("occurrences") > 0, F.struct("signal_name", "occurrences"))
    return per_rule.groupBy("record_identifier").agg(
        F.min("data_trust_index").alias("own_index"),
        F.collect_list(failing).alias("own_failures"),
    )


def _table_wide(partner: DataFrame) -> tuple[Column, Column]:
    """Index and blocking failures of table-scoped assessments, as scalar subqueries."""
    rows = partner.filter(F.col("scope_object") == SCOPES["liabilities"])
    index = rows.agg(F.min("data_trust_index").alias("v")).scalar()
    failures = (
        _blocking(rows).groupBy("signal_name").agg(F.count(F.lit(1)).alias("occurrences"))
        .agg(_as_pairs().alias("v")).scalar()
    )
    return index, failures


def _merge_pairs(left: Column, right: Column) -> Column:
    """Add up occurrences of rules present in both lists."""
    both = F.concat(left, right)
    names = F.array_distinct(F.transform(both, lambda p: p["signal_name"]))
    return F.sort_array(F.transform(names, lambda name: F.struct(
        name.alias("signal_name"),
        F.aggregate(
            F.filter(both, lambda p: p["signal_name"].eqNullSafe(name)),
            F.lit(0).cast("bigint"), lambda acc, p: acc + p["occurrences"],
        ).alias("occurrences"),
    )))


def with_partner(state: DataFrame, applicants: DataFrame, partner: DataFrame | None) -> DataFrame:
    """Add ``partner_trust_index`` and ``partner_blocking_failures``.

    Partners name records by text. The match is made on a narrow table of ids,
    so that the wide state is joined on the key it already lies by. The rules
    of table-wide assessments travel as one short list: rule names are a
    catalogue of the partner's, not data that grows with the records.
    """
    if partner is None:
        return state.withColumns({
            "partner_trust_index": F.lit(None).cast(INDEX),
            "partner_blocking_failures": F.array().cast(_NO_FAILURES),
        })
    index, failures = _table_wide(partner)
    empty = F.array().cast(_NO_FAILURES)
    ids = applicants.select("applicant_id", F.col("applicant_id").cast("string").alias("record_identifier")).distinct()
    own = ids.join(partner_by_entity(partner), "record_identifier").drop("record_identifier")
    joined = state.join(own, "applicant_id", "left")
    return (
        joined.withColumns({
            # least() skips a missing side, like a minimum over the combined rows
            "partner_trust_index": F.least(F.col("own_index"), index),
            "own_failures": F.coalesce(F.col("own_failures"), empty),
            "wide_failures": F.coalesce(failures, empty),
        })
        .withColumn("partner_blocking_failures",
                    _merge_pairs(F.col("own_failures"), F.col("wide_failures")))
        .drop("own_index", "own_failures", "wide_failures")
    )


def _strict_checks(as_of: AsOf, thresholds: DataFrame) -> list[Column]:
    """Further blocking rules that the default verdict measures but does not act on."""
    out = []
    for scope, column in (("income", "income_loaded_at"), ("repayment", "repayment_loaded_at"),
                          ("applicants", "loaded_at")):
        rule = thresholds.filter(
            (F.col("scope_object") == SCOPES[scope])
            & (F.col("signal_dimension") == "TIMELINESS") & F.col("is_blocking")
        )
        limit, name = rule.select("fail_at").scalar(), rule.select("signal_name").scalar()
        out.append(F.when(day_age(F.col(column), as_of) >= limit, name))
    out.append(F.when(F.size("partner_blocking_failures") > 0, "PARTNER_SIGNAL"))
    return out


def with_verdict(
    state: DataFrame,
    sources: Sources,
    as_of: AsOf,
    thresholds: DataFrame,
    partner: DataFrame | None = None,
    strict: bool = False,
    content_keys: Sequence[str] = CONTENT_KEYS,
    duplicates: DataFrame | None = None,
) -> DataFrame:
    """Add the verdict columns and the retained ``trust_detail`` struct to an entity state.

    ``strict`` also blocks on every other blocking timeliness rule and on the
    partner's blocking failures. ``duplicates``: the content duplicates where
    they are kept; else they are counted.
    """
    if duplicates is None:
        duplicates = content_duplicates(sources.liabilities, content_keys)
    copies = duplicates.select("applicant_id", F.col("duplicate_groups").alias("duplicate_liabilities"))
    s = with_partner(state.join(copies, "applicant_id", "left"), sources.applicants, partner)
    limit = fail_limit(thresholds, LIABILITY_STALENESS)
    s = s.withColumns({
        "worst_staleness_days": F.coalesce(F.col("max_liability_staleness_days"), F.lit(0)),
        "stale_feeds": F.coalesce(F.col("stale_feeds"), F.array().cast("array<string>")),
        "pct_exposure_from_failed_records": F.coalesce(
            share(F.col("exposure_from_failed_records"), F.col("outstanding_exposure")),
            F.lit(0).cast(PERCENT)),
        "income_missing": F.coalesce(F.col("known_incomes"), F.lit(0)) == 0,
        "duplicate_liabilities": F.coalesce(F.col("duplicate_liabilities"), F.lit(0)),
    })
    checks = [
        F.when(F.col("worst_staleness_days") >= limit, LIABILITY_STALENESS),
        F.when(F.col("income_missing"), INCOME_COMPLETENESS),
        F.when(F.col("duplicate_liabilities") > 0, LIABILITY_UNIQUENESS),
    ]
    if strict:
        checks += _strict_checks(as_of, thresholds)
    s = s.withColumn("blocking_failures", F.array_compact(F.array(*checks)))
    s = s.withColumn(
        "verdict", F.when(F.size("blocking_failures") > 0, "NOT_TRUSTED").otherwise("TRUSTED"))
    return s.withColumn("trust_detail", F.struct(
        F.col("applicant_id"),
        instant(as_of).alias("evaluated_at"),
        F.col("worst_staleness_days"),
        F.col("stale_feeds"),
        F.col("pct_exposure_from_failed_records").alias("pct_exposure_from_stale_feeds"),
        F.col("income_missing"),
        F.col("duplicate_liabilities"),
        F.col("partner_trust_index"),
        F.col("partner_blocking_failures"),
        F.col("blocking_failures"),
        F.col("verdict"),
    ))


def entity_trust(
    sources: Sources, as_of: AsOf, thresholds: DataFrame,
    partner: DataFrame | None = None, strict: bool = False,
) -> DataFrame:
    """One verdict per applicant, as top-level columns."""
    state = entity_state(sources, as_of, thresholds)
    return with_verdict(state, sources, as_of, thresholds, partner, strict).select("trust_detail.*")
