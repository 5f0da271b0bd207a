"""Predicates and ladders shared by several operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def outside_domain(value: Column, accepted: Sequence) -> Column:
    """True where the value is missing or not one of the accepted ones."""
    return value.isNull() | ~value.isin(*accepted)


def grade(value: Column, rule_name: Column, warn_at: Column, fail_at: Column) -> Column:
    """PASS / WARN / FAIL at-or-above the limits; UNGOVERNED where no rule exists."""
    return (
        F.when(rule_name.isNull(), "UNGOVERNED")
        .when(value >= fail_at, "FAIL")
        .when(value >= warn_at, "WARN")
        .otherwise("PASS")
    )


def severity_rank(status: Column) -> Column:
    return F.when(status == "FAIL", 1).when(status == "WARN", 2).when(status == "UNGOVERNED", 3).otherwise(4)


def risk_tier(income: Column, obligations: Column, ratio: Column, missed: Column) -> Column:
    """Lending tier from the guarded ratio.

    An income of zero has no ratio, so it is UNKNOWN like a missing one.
    """
    late = F.coalesce(missed, F.lit(0))
    return (
        F.when(income.isNull() | obligations.isNull() | ratio.isNull(), "TIER_UNKNOWN")
        .when((ratio < 30) & (late == 0), "TIER_1_LOW")
        .when((ratio < 40) & (late <= 1), "TIER_2_MODERATE")
        .when((ratio < 50) & (late <= 2), "TIER_3_ELEVATED")
        .otherwise("TIER_4_HIGH")
    )


def policy_outcome(ratio: Column, missed: Column) -> Column:
    """Credit policy v1.0 on its own; a missing ratio falls through to DECLINE."""
    late = F.coalesce(missed, F.lit(0))
    return (
        F.when((ratio < 40) & (late <= 1), "APPROVE")
        .when((ratio < 50) & (late <= 2), "REFER_TO_HUMAN")
        .otherwise("DECLINE")
    )


def counterfactual(ratio: Column, missed: Column) -> Column:
    """What policy alone would have said, where it can say anything."""
    return F.when(ratio.isNull(), "UNDECIDABLE").otherwise(policy_outcome(ratio, missed))
