"""Feed-level trust signals and the unified surface that consumers read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.functions.clock import AsOf, day_age, hour_age
from surety.functions.rules import grade, severity_rank
from surety.model import INDEX, LIABILITY_STALENESS, MEASURE, SCOPES, Sources

NATIVE, PARTNER = "NATIVE", "PARTNER"


def feed_loads(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and last load per (scope, feed); any table with a feed and a load time will do."""
    parts = [
        df.groupBy(F.col("source_system").alias("feed_name"))
        .agg(F.count(F.lit(1)).alias("record_count"), F.max("loaded_at").alias("last_loaded_at"))
        .select(F.lit(scope).alias("scope_object"), "feed_name", "record_count", "last_loaded_at")
        for scope, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def scoped(sources: Sources, **more: DataFrame) -> dict[str, DataFrame]:
    """Scope name to table, plus any further feed-bearing tables."""
    tables = {SCOPES[n]: df for n, df in sources.items()}
    return {**tables, **{f"RAW.{n.upper()}": df for n, df in more.items()}}


def grade_feeds(loads: DataFrame, as_of: AsOf, thresholds: DataFrame) -> DataFrame:
    """Grade feeds against the timeliness rule of their scope.

    A scope with two timeliness rules yields two rows per feed.
    """
    rules = thresholds.filter(F.col("signal_dimension") == "TIMELINESS").select(
        "scope_object", "signal_name", "warn_at", "fail_at", "is_blocking", "owner_team")
    days = F.col("staleness_days")
    return (
        loads.withColumns({
            "staleness_days": day_age(F.col("last_loaded_at"), as_of),
            "staleness_hours": hour_age(F.col("last_loaded_at"), as_of),
        })
        .join(rules, "scope_object", "left")
        .withColumns({
            "trust_status": grade(days, F.col("signal_name"), F.col("warn_at"), F.col("fail_at")),
            "signal_source": F.lit(NATIVE),
        })
    )


def feed_trust(tables: dict[str, DataFrame], as_of: AsOf, thresholds: DataFrame) -> DataFrame:
    """One row per (table, feed), 13 columns."""
    return grade_feeds(feed_loads(tables), as_of, thresholds)


def unified_signals(feeds: DataFrame, partner: DataFrame | None = None, with_ids: bool = False) -> DataFrame:
    """Native feed signals and partner signals in one 13-column shape.

    A feed without a rule carries the liability rule's name, whatever its
    table; its status (UNGOVERNED) is what tells it apart. ``with_ids`` adds
    the partner's own ``signal_id`` (NULL for native signals).
    """
    native = feeds.select(
        "signal_source", "scope_object", "feed_name",
        F.lit(None).cast("string").alias("record_identifier"),
        F.coalesce("signal_name", F.lit(LIABILITY_STALENESS)).alias("signal_name"),
        F.lit("TIMELINESS").alias("signal_dimension"),
        F.col("staleness_days").cast(MEASURE).alias("measured_value"),
        F.lit("days").alias("unit"),
        F.lit(None).cast(INDEX).alias("data_trust_index"),
        "trust_status",
        F.coalesce("is_blocking", F.lit(False)).alias("is_blocking"),
        F.col("last_loaded_at").alias("evaluated_at"),
        F.format_string("Feed last loaded %d days ago; %d records affected.",
                        F.col("staleness_days"), F.col("record_count")).alias("detail"),
    )
    if with_ids:
        native = native.withColumn("signal_id", F.lit(None).cast("string"))
    if partner is None:
        return native
    delivered = partner.select(
        F.lit(PARTNER).alias("signal_source"), "scope_object", "feed_name", "record_identifier",
        "signal_name", "signal_dimension", "measured_value",
        F.lit(None).cast("string").alias("unit"), "data_trust_index", "trust_status",
        F.coalesce("is_blocking", F.lit(False)).alias("is_blocking"), "evaluated_at", "detail",
        *(["signal_id"] if with_ids else []),
    )
    return native.unionByName(delivered)


def ranked_feeds(feeds: DataFrame) -> DataFrame:
    """Worst first: by severity, then by age."""
    return feeds.orderBy(severity_rank(F.col("trust_status")), F.desc("staleness_days"),
                         "scope_object", "feed_name")


def worst_failing_feed(feeds: DataFrame) -> DataFrame:
    return ranked_feeds(feeds.filter(F.col("trust_status") == "FAIL")).limit(1)


def ranked_thresholds(thresholds: DataFrame) -> DataFrame:
    return thresholds.orderBy(F.desc("is_blocking"), "signal_name")


def governed_thresholds(thresholds: DataFrame, loads: DataFrame) -> DataFrame:
    """Each rule with the feeds and records it currently governs (timeliness rules only)."""
    per_scope = loads.groupBy("scope_object").agg(
        F.count(F.lit(1)).alias("feeds"), F.sum("record_count").alias("records"))
    timely = F.col("signal_dimension") == "TIMELINESS"
    return thresholds.join(per_scope, "scope_object", "left").withColumns({
        "governed_feeds": F.when(timely, F.coalesce("feeds", F.lit(0))).otherwise(0).cast("bigint"),
        "governed_records": F.when(timely, F.coalesce("records", F.lit(0))).otherwise(0).cast("bigint"),
    }).drop("feeds", "records")
