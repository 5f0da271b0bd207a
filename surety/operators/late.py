"""Late-arriving data: upsert of a delayed batch, and a feed catching up as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.functions.clock import AsOf, day_age, hours_before

KEY = "liability_id"
REFRESHED = ("outstanding_balance", "monthly_payment", "effective_date", "loaded_at")
CAUGHT_UP_AFTER_DAYS = 7


def one_row_per_key(batch: DataFrame, key: str = KEY, what: str = "late batch") -> DataFrame:
    """The batch, failing the job if a key comes twice (the outcome would depend on order)."""
    rest = [c for c in batch.columns if c != key]
    counted = batch.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(F.struct(*rest), F.lit(1)).alias("_row"))
    twice = F.concat(F.lit(f"{what} holds more than one row for {key} "), F.col(key).cast("string"))
    checked = F.when(F.col("_n") > 1, F.raise_error(twice)).otherwise(F.col("_n"))
    # the filter keeps the check alive whatever columns a later step asks for
    return counted.filter(checked == 1).select(key, "_row.*").select(*batch.columns)


def merge_late(facts: DataFrame, batch: DataFrame, key: str = KEY, refreshed: tuple = REFRESHED) -> DataFrame:
    """Known rows get the batch's figures; rows never seen before are added.

    One full outer join on the key gives updated, untouched and unseen rows at
    once: facts and batch are read once each. Rows without a key match nothing.
    """
    other = {c: f"_new_{c}" for c in facts.columns}
    incoming = one_row_per_key(batch, key).select(
        *[F.col(c).alias(n) for c, n in other.items()], F.lit(True).alias("_new"))
    known = facts.withColumn("_known", F.lit(True))
    both = known.join(incoming, F.col(key) == F.col(other[key]), "full_outer")
    return both.select(*[
        F.when(F.col("_new") if c in refreshed else F.col("_known").isNull(), F.col(n)).otherwise(F.col(c)).alias(c)
        for c, n in other.items()
    ])


def feed_catch_up(facts: DataFrame, feed: str, as_of: AsOf, hours_ago: int = 2,
                  older_than_days: int = CAUGHT_UP_AFTER_DAYS) -> DataFrame:
    """Mark every overdue row of one feed as loaded ``hours_ago``; other rows are untouched."""
    overdue = (F.col("source_system") == feed) & (day_age(F.col("loaded_at"), as_of) > older_than_days)
    now = hours_before(as_of, F.lit(hours_ago))
    return facts.withColumn("loaded_at", F.when(overdue, now).otherwise(F.col("loaded_at")))


def apply_late(facts: DataFrame, batch: DataFrame, feed: str, as_of: AsOf) -> DataFrame:
    return feed_catch_up(merge_late(facts, batch), feed, as_of)
