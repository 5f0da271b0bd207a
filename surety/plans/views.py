"""The public surface as SQL views, for readers who come with ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surety.functions.clock import AsOf
from surety.model import Sources
from surety.operators import audit as audit_ops
from surety.operators.profile import credit_profile
from surety.operators.signals import feed_trust, scoped, unified_signals
from surety.plans.assess import Decisions


def views(
    sources: Sources, decisions: Decisions, as_of: AsOf, thresholds: DataFrame,
    partner: DataFrame | None = None,
) -> dict[str, DataFrame]:
    profile = credit_profile(sources, as_of, thresholds)
    feeds = feed_trust(scoped(sources), as_of, thresholds)
    return {
        "v_applicant_credit_profile": profile,
        "v_feed_trust_signals": feeds,
        "v_unified_trust_signals": unified_signals(feeds, partner),
        "v_decision_audit_trail": audit_ops.audit_trail(decisions.audit, sources.applicants),
        "v_decision_source_lineage": audit_ops.source_lineage(
            decisions.audit, decisions.sources, sources.liabilities),
        "v_trust_at_decision": audit_ops.frozen_trust(decisions.audit, decisions.batch),
        "v_decision_drift": audit_ops.drift(decisions.audit, profile),
    }


def register_views(spark: SparkSession, *args, **kwargs) -> list[str]:
    made = views(*args, **kwargs)
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return list(made)
