"""The liability rollup kept up to date by change sets, so that a late batch does not make everybody be computed again.

The kept state is a partial aggregate per (entity, feed, load day). It holds no ages: how stale a day is depends on the
instant asked for, and is worked out from the day when the state is read, so one state serves every ``as_of``.

A late batch is turned into a change set: the old row of every touched record with sign -1, its new row with +1. Counts,
sums and the digest of the state change by adding the signed rows up. What cannot be taken back (first and last load,
content duplicates) is read again, for the affected entities only: their facts are found by a semi-join, and those of all
other entities are neither moved nor aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.clock import AsOf, day_age, hours_before
from surety.functions.ids import digest_part
from surety.model import LIABILITY_STALENESS, TOTAL
from surety.operators import late
from surety.operators.exposure import CONTENT_KEYS, STALE_AFTER_DAYS, content_duplicates, fail_limit

GRAIN = ("applicant_id", "source_system", "loaded_on")
_SUMS = {"n": "bigint", "n_balance": "bigint", "balance": "decimal(38,2)", "n_payment": "bigint", "payment": "decimal(38,2)",
         "digest": "decimal(38,0)"}


def _signed(sign: Column) -> list[Column]:
    """What one record adds to its group, times the sign; known amounts are counted, as a sum over none is not zero."""
    known = lambda c: F.col(c).isNotNull().cast("bigint")
    amount = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(12,2)"))
    parts = {"n": F.lit(1), "n_balance": known("outstanding_balance"), "balance": amount("outstanding_balance"),
             "n_payment": known("monthly_payment"), "payment": amount("monthly_payment"), "digest": digest_part(F.col("liability_id"))}
    return [F.sum(sign * parts[name]).cast(t).alias(name) for name, t in _SUMS.items()]


def _with_day(facts: DataFrame) -> DataFrame:
    return facts.withColumn("loaded_on", F.to_date("loaded_at"))


def _ends() -> list[Column]:
    return [F.min("loaded_at").alias("oldest"), F.max("loaded_at").alias("newest")]


def rollup_state(facts: DataFrame) -> DataFrame:
    """The state of a whole table: what :func:`maintain` keeps, one row per entity, feed and load day."""
    return _with_day(facts).groupBy(*GRAIN).agg(*_signed(F.lit(1)), *_ends())


def exposure_of(state: DataFrame, as_of: AsOf, thresholds: DataFrame, stale_after_days: int = STALE_AFTER_DAYS) -> DataFrame:
    """The columns of :func:`surety.operators.exposure.exposure`, read from the state."""
    age = day_age(F.col("loaded_on"), as_of)
    failed = age >= fail_limit(thresholds, LIABILITY_STALENESS)
    balance = F.when(F.col("n_balance") > 0, F.col("balance"))
    payment = F.when(F.col("n_payment") > 0, F.col("payment"))
    zero = F.lit(0).cast("decimal(38,2)")
    by_feed = state.groupBy("applicant_id", "source_system").agg(
        F.sum("n").alias("n"),
        F.sum(balance).alias("exposure"), F.sum(payment).alias("obligations"),
        F.sum(F.when(age > stale_after_days, balance).otherwise(zero)).alias("stale"),
        F.sum(F.when(failed, balance).otherwise(zero)).alias("failed"),
        F.count_if(failed).alias("n_failed"),
        F.min("oldest").alias("oldest"), F.max("newest").alias("newest"),
        F.sum("digest").alias("digest"),
    )
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


def _overdue(feed: str, as_of: AsOf) -> Column:
    late_row = (F.col("source_system") == feed) & (day_age(F.col("loaded_at"), as_of) > late.CAUGHT_UP_AFTER_DAYS)
    return F.coalesce(late_row, F.lit(False))


def change_set(facts: DataFrame, batch: DataFrame, feed: str | None = None, as_of: AsOf | None = None) -> DataFrame:
    """The rows a late batch changes: ``sign`` -1 for a record as it was, +1 as it is afterwards.

    Touched are the records the batch names and, if ``feed`` catches up as a whole, the feed's overdue ones. The first are
    found by a semi-join on the key, the second by a filter that reaches the scan (and prunes, in a table laid out by
    feed). A record without a key is touched by the feed only. Taking the -1 rows out of the table and putting the +1 rows
    in gives :func:`surety.operators.late.apply_late` of it.
    """
    named = batch.select(late.KEY)
    if feed is None:
        touched = facts.join(named, late.KEY, "left_semi")
    else:
        overdue = _overdue(feed, as_of)
        touched = facts.filter(overdue).unionByName(facts.filter(~overdue).join(named, late.KEY, "left_semi").select(*facts.columns))
    columns = facts.columns
    incoming = late.one_row_per_key(batch).select(*[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_new"))
    both = touched.withColumn("_known", F.lit(True)).join(incoming, F.col(late.KEY) == F.col(f"_new_{late.KEY}"), "full_outer")
    after = {c: F.when(F.col("_new") if c in late.REFRESHED else F.col("_known").isNull(), F.col(f"_new_{c}")).otherwise(F.col(c))
             for c in columns}
    both = both.withColumns({f"_now_{c}": x for c, x in after.items()})
    if feed is not None:
        still = (F.col("_now_source_system") == feed) & (day_age(F.col("_now_loaded_at"), as_of) > late.CAUGHT_UP_AFTER_DAYS)
        both = both.withColumn("_now_loaded_at", F.when(still, hours_before(as_of, F.lit(2))).otherwise(F.col("_now_loaded_at")))
    was = F.when(F.col("_known"), F.struct(F.lit(-1).alias("sign"), *[F.col(c).alias(c) for c in columns]))
    now = F.struct(F.lit(1).alias("sign"), *[F.col(f"_now_{c}").alias(c) for c in columns])
    return both.select(F.explode(F.array_compact(F.array(was, now))).alias("r")).select("r.*")


@dataclass(frozen=True)
class Maintained:
    """What is kept between two rounds. ``affected``: entities that the last batch touched; None before the first."""

    state: DataFrame
    copies: DataFrame
    affected: DataFrame | None = None

    def exposure(self, as_of: AsOf, thresholds: DataFrame) -> DataFrame:
        return exposure_of(self.state, as_of, thresholds)

    def restricted(self) -> "Maintained":
        """Only the affected entities."""
        return Maintained(_of(self.state, self.affected, "left_semi"), _of(self.copies, self.affected, "left_semi"), self.affected)


def _of(df: DataFrame, affected: DataFrame, how: str) -> DataFrame:
    """Rows of the affected entities (left_semi), or of all others (left_anti); a null entity is one like any other."""
    names = affected.select(F.col("applicant_id").alias("_affected"))
    return df.join(names, F.col("applicant_id").eqNullSafe(F.col("_affected")), how)


def start(facts: DataFrame, content_keys: Sequence[str] = CONTENT_KEYS) -> Maintained:
    """State and content duplicates of a whole table: the one full pass."""
    return Maintained(rollup_state(facts), content_duplicates(facts, content_keys))


def maintain(
    kept: Maintained, facts: DataFrame, batch: DataFrame, feed: str | None = None, as_of: AsOf | None = None,
    content_keys: Sequence[str] = CONTENT_KEYS,
) -> Maintained:
    """The kept state after a late batch; equal to :func:`start` on the table with the batch applied.

    ``facts``: the table before the batch. Entities may be null or lose all their records (a batch never moves a record to
    another entity, so here they do not); groups with no record left disappear. An empty batch changes nothing.
    """
    changes = change_set(facts, batch, feed, as_of)
    affected = changes.select("applicant_id").distinct()
    delta = _with_day(changes).groupBy(*GRAIN).agg(*_signed(F.col("sign")))
    # the entities' own facts, old and new: the table's, corrected by the change set, as far as they are affected
    theirs = late.merge_late(_of(facts, affected, "left_semi"), batch)
    if feed is not None:
        theirs = late.feed_catch_up(theirs, feed, as_of)
    ends = _with_day(theirs).groupBy(*GRAIN).agg(*_ends())
    held = _of(kept.state, affected, "left_semi").select(*GRAIN, *_SUMS)
    moved = held.unionByName(delta).groupBy(*GRAIN).agg(*[F.sum(c).cast(t).alias(c) for c, t in _SUMS.items()]).filter("n > 0")
    met = moved.alias("m").join(ends.alias("e"), [F.col(f"m.{c}").eqNullSafe(F.col(f"e.{c}")) for c in GRAIN], "left")
    fresh = met.select(*[F.col(f"m.{c}") for c in (*GRAIN, *_SUMS)], "e.oldest", "e.newest")
    others = _of(kept.state, affected, "left_anti").select(*GRAIN, *_SUMS, "oldest", "newest")
    copies = _of(kept.copies, affected, "left_anti").unionByName(content_duplicates(theirs, content_keys))
    return Maintained(others.unionByName(fresh), copies, affected)
