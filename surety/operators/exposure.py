"""Per-entity rollup of the liability facts: totals, provenance, content duplicates.

Two narrow passes instead of one wide one: totals are grouped by (entity,
feed) and then by entity, duplicates by (entity, content) and then by entity.
Every grouping combines on the map side, so an entity, a feed or a group of
copies that owns a third of the table arrives at its reducer as a handful of
partial rows, and only fixed-width values are kept per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.clock import AsOf, day_age
from surety.functions.ids import digest_part
from surety.model import LIABILITY_STALENESS, TOTAL

CONTENT_KEYS = ("liability_type", "outstanding_balance")
STALE_AFTER_DAYS = 7  # strict: a record of exactly seven days is still fresh here


def fail_limit(thresholds: DataFrame, signal_name: str) -> Column:
    """The governed FAIL limit of one signal, as a scalar subquery."""
    return thresholds.filter(F.col("signal_name") == signal_name).select("fail_at").scalar()


def exposure(
    liabilities: DataFrame,
    as_of: AsOf,
    thresholds: DataFrame,
    stale_after_days: int = STALE_AFTER_DAYS,
) -> DataFrame:
    """Totals and provenance: one row per entity that has at least one liability."""
    age = day_age(F.col("loaded_at"), as_of)
    failed = age >= fail_limit(thresholds, LIABILITY_STALENESS)
    balance = F.col("outstanding_balance")
    zero = F.lit(0).cast("decimal(12,2)")
    by_feed = liabilities.groupBy("applicant_id", "source_system").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(balance).alias("exposure"),
        F.sum("monthly_payment").alias("obligations"),
        F.sum(F.when(age > stale_after_days, balance).otherwise(zero)).alias("stale"),
        F.sum(F.when(failed, balance).otherwise(zero)).alias("failed"),
        F.count_if(failed).alias("n_failed"),
        F.min("loaded_at").alias("oldest"),
        F.max("loaded_at").alias("newest"),
        F.sum(digest_part(F.col("liability_id"))).alias("digest"),
    )
    # from here on an entity has one row per feed, so the lists are as short as that
    feed = F.col("source_system")
    return by_feed.groupBy("applicant_id").agg(
        F.sum("exposure").cast(TOTAL).alias("outstanding_exposure"),
        F.sum("obligations").cast(TOTAL).alias("monthly_obligations"),
        F.sum("n").alias("liability_count"),
        F.sum("digest").cast("decimal(38,0)").alias("liability_digest"),
        F.sum("stale").cast(TOTAL).alias("exposure_from_stale_feeds"),
        F.sum("failed").cast(TOTAL).alias("exposure_from_failed_records"),
        F.min("oldest").alias("oldest_liability_loaded_at"),
        F.max("newest").alias("newest_liability_loaded_at"),
        F.sort_array(F.collect_list(feed)).alias("liability_feeds_used"),
        F.sort_array(F.collect_list(F.when(F.col("n_failed") > 0, feed))).alias("stale_feeds"),
    ).withColumn("max_liability_staleness_days", day_age(F.col("oldest_liability_loaded_at"), as_of))


def content_duplicates(liabilities: DataFrame, content_keys: Sequence[str] = CONTENT_KEYS) -> DataFrame:
    """Per entity with any: how many groups of same-content records under different ids."""
    return (
        liabilities.groupBy("applicant_id", *content_keys)
        .count()
        .filter("count > 1")
        .groupBy("applicant_id")
        .agg(F.count(F.lit(1)).alias("duplicate_groups"), F.sum("count").alias("records_involved"))
    )
