"""Data-quality metrics, their bindings to columns, batch evaluation and grading."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.clock import AsOf, instant, second_age
from surety.functions.rules import grade, outside_domain

LAG_DAYS = 7


# Aggregate expressions, usable in any agg() ---------------------------------
def freshness(loaded_at: Column, as_of: AsOf) -> Column:
    """Seconds since the newest load. One live feed is enough to make it small."""
    return second_age(F.max(loaded_at), as_of)


def null_count(value: Column) -> Column:
    return F.count_if(value.isNull())


def accepted_values(value: Column, accepted: Sequence) -> Column:
    """Count of values outside the accepted ones, missing included."""
    return F.count_if(outside_domain(value, accepted))


# Metrics that need more than one aggregation --------------------------------
def lagging_records(df: DataFrame, loaded_at: str = "loaded_at", days: int = LAG_DAYS) -> DataFrame:
    """Records more than ``days`` behind the table's own newest load, in total.

    Relative to the data, not to the clock, so the answer is stable between loads.
    """
    return df.agg(F.count_if(_lags(df, loaded_at, days)).alias("lagging_records"))


def lagging_by_feed(df: DataFrame, loaded_at: str = "loaded_at", days: int = LAG_DAYS) -> DataFrame:
    return df.groupBy(F.col("source_system").alias("feed_name")).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(_lags(df, loaded_at, days)).alias("lagging_records"),
    )


def _lags(df: DataFrame, loaded_at: str, days: int) -> Column:
    newest = df.agg(F.max(loaded_at).alias("newest")).scalar()
    return F.col(loaded_at) < F.timestamp_add("DAY", F.lit(-days), newest)


def key_collisions(df: DataFrame, *key: str) -> DataFrame:
    """Key values that occur more than once, with how often."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def duplicate_key_count(df: DataFrame, *key: str) -> DataFrame:
    """Rows beyond the first of each non-null key, in total."""
    known = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]))
    return (
        known.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("surplus"))
        .agg(F.coalesce(F.sum("surplus"), F.lit(0)).cast("bigint").alias("duplicate_keys"))
    )


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose (non-null) key has no parent.

    The child is reduced to keys with counts first, so a hot key meets the
    parent side as one row.
    """
    counted = (
        child.filter(F.col(child_key).isNotNull())
        .groupBy(F.col(child_key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    )
    return counted.join(parent.select(F.col(parent_key).alias("_key")), "_key", "left_anti")


def orphan_count(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return orphans(child, parent, child_key, parent_key).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("orphan_records"),
        F.count(F.lit(1)).alias("orphan_keys"),
    )


def entity_completeness(entities: DataFrame, side: DataFrame, key: str, value: str) -> DataFrame:
    """Per entity: is there no side row with a known value?"""
    known = side.groupBy(key).agg(F.count(value).alias("known"))
    return entities.select(key).join(known, key, "left").select(
        key, (F.coalesce("known", F.lit(0)) == 0).alias("missing"))


# Bindings -------------------------------------------------------------------
@dataclass(frozen=True)
class MetricBinding:
    """A metric attached to a column of a table.

    ``kind`` names one of the metrics below; ``dimension`` says which governed
    rule of the table's scope it is graded by.
    """

    scope_object: str
    column: str
    kind: str
    dimension: str
    accepted: tuple = ()


def _simple(binding: MetricBinding, as_of: AsOf) -> Column | None:
    column = F.col(binding.column)
    build: dict[str, Callable[[], Column]] = {
        "FRESHNESS": lambda: freshness(column, as_of),
        "NULL_COUNT": lambda: null_count(column),
        "INVALID_VALUE_COUNT": lambda: accepted_values(column, binding.accepted),
    }
    made = build.get(binding.kind)
    return made() if made else None


def _labelled(value: Column, binding: MetricBinding) -> Column:
    return F.struct(
        F.lit(binding.scope_object).alias("scope_object"), F.lit(binding.column).alias("column_name"),
        F.lit(binding.kind).alias("metric"), F.lit(binding.dimension).alias("signal_dimension"),
        value.cast("bigint").alias("measured"),
    )


def evaluate(
    tables: dict[str, DataFrame],
    bindings: Sequence[MetricBinding],
    as_of: AsOf,
    parents: dict[str, tuple[DataFrame, str]] | None = None,
) -> DataFrame:
    """All bindings as rows (scope, column, metric, dimension, measured, evaluated_at).

    The plain metrics of a table share one aggregate pass. Lag needs the
    newest load first; key duplicates and orphans need a grouping of their own.
    ``parents`` maps a bound column to (parent table, parent key) for ORPHAN_COUNT.
    """
    parts: list[DataFrame] = []
    for scope, df in tables.items():
        mine = [b for b in bindings if b.scope_object == scope]
        plain = [(b, _simple(b, as_of)) for b in mine]
        plain = [(b, c) for b, c in plain if c is not None]
        lag = [b for b in mine if b.kind == "LAGGING_RECORD_COUNT"]
        one_pass = [(b, c) for b, c in plain] + [(b, F.count_if(_lags(df, b.column, LAG_DAYS))) for b in lag]
        if one_pass:
            row = df.agg(*[c.alias(f"m{i}") for i, (_, c) in enumerate(one_pass)])
            parts.append(row.select(F.inline(F.array(
                *[_labelled(F.col(f"m{i}"), b) for i, (b, _) in enumerate(one_pass)]))))
        for b in mine:
            if b.kind == "DUPLICATE_COUNT":
                value = duplicate_key_count(df, b.column)
            elif b.kind == "ORPHAN_COUNT":
                parent, parent_key = (parents or {})[b.column]
                value = orphan_count(df, parent, b.column, parent_key).select("orphan_records")
            else:
                continue
            parts.append(value.select(F.inline(F.array(_labelled(F.col(value.columns[0]), b)))))
    return reduce(DataFrame.unionByName, parts).withColumn("evaluated_at", instant(as_of))


def grade_metrics(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Grade count metrics by the governed rule of their scope and dimension.

    Ages and lag counts are no counts of bad records, so no limit applies to
    them: they stay in the result as NOT_GRADED, without a rule.
    """
    rules = thresholds.select(
        "scope_object", "signal_dimension", "signal_name", "warn_at", "fail_at", "is_blocking", "owner_team")
    ungraded = F.col("metric").isin("FRESHNESS", "LAGGING_RECORD_COUNT")
    graded = metrics.withColumn("_rule_scope", F.when(~ungraded, F.col("scope_object"))).join(
        rules.withColumnRenamed("scope_object", "_rule_scope"), ["_rule_scope", "signal_dimension"], "left")
    status = grade(F.col("measured"), F.col("signal_name"), F.col("warn_at"), F.col("fail_at"))
    return graded.drop("_rule_scope").withColumn("trust_status", F.when(ungraded, "NOT_GRADED").otherwise(status))
