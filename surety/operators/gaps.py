"""When did a feed deliver, and when was it silent? Sessions of loads, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from surety.functions.clock import AsOf, instant

SILENT_AFTER = "1 hour"


def load_sessions(df: DataFrame, silent_after: str = SILENT_AFTER) -> DataFrame:
    """Per feed: spells of loads with at most ``silent_after`` between one and the next.

    A load exactly that long after the last one still belongs to its session. Sessions
    are found per feed and day first, so that a feed which delivers a third of
    all records is not sorted in one task; what is stitched together across
    midnight is one row per session. Records without a load time are in none.
    """
    loads = df.filter(F.col("loaded_at").isNotNull()).select(F.col("source_system").alias("feed_name"), "loaded_at")
    daily = loads.groupBy("feed_name", F.to_date("loaded_at").alias("_day"), F.session_window("loaded_at", silent_after).alias("_s")).agg(
        F.count(F.lit(1)).alias("records"), F.max("loaded_at").alias("last_load_at"))
    parts = daily.select("feed_name", "records", "last_load_at", F.col("_s.start").alias("first_load_at"), F.col("_s.end").alias("_until"))
    by_time = Window.partitionBy("feed_name").orderBy("first_load_at")
    begins = F.col("first_load_at") > F.lag("_until").over(by_time)
    numbered = parts.withColumn("_begins", F.coalesce(begins, F.lit(True)).cast("int")).withColumn("_session", F.sum("_begins").over(by_time))
    return numbered.groupBy("feed_name", "_session").agg(
        F.min("first_load_at").alias("first_load_at"), F.max("last_load_at").alias("last_load_at"), F.sum("records").alias("records"),
    ).drop("_session")


def feed_gaps(df: DataFrame, as_of: AsOf, silent_after: str = SILENT_AFTER) -> DataFrame:
    """Every session with the silence after it: until the next one, or until ``as_of`` where there is none (``still_silent``)."""
    following = F.lead("first_load_at").over(Window.partitionBy("feed_name").orderBy("first_load_at"))
    return load_sessions(df, silent_after).withColumn("_next", following).select(
        "feed_name", "first_load_at", "last_load_at", "records",
        (F.unix_timestamp(F.coalesce("_next", instant(as_of))) - F.unix_timestamp("last_load_at")).alias("silent_seconds"),
        F.col("_next").isNull().alias("still_silent"))
