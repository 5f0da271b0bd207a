"""Extension: feed liveness kept up to date from a stream of loads, also for feeds that deliver nothing any more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from surety.functions.clock import AsOf
from surety.operators.signals import grade_feeds


def heartbeat(spark: SparkSession) -> DataFrame:
    """A stream of ticks, one a second, that belong to no feed: with it, feeds are graded though no row of any arrives."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return ticks.select(F.col("timestamp").alias("loaded_at"))


def feed_loads_stream(
    stream: DataFrame, scope: str, beat: DataFrame | None = None, arrived: str | None = None, late_after: str = "1 day"
) -> DataFrame:
    """Running count and last load per feed; the state is one row per feed.

    ``beat``: a stream of ticks (see :func:`heartbeat`), counted under no feed.
    ``arrived``: the column that says when a row came in; rows that came more
    than ``late_after`` after their load time are counted as late.
    """
    late = F.lit(False) if arrived is None else F.col(arrived) > F.col("loaded_at") + F.expr(f"INTERVAL {late_after}")
    rows = stream.select("source_system", "loaded_at", late.alias("_late"), F.lit(False).alias("_tick"))
    if beat is not None:
        rows = rows.unionByName(beat.select(
            F.lit(None).cast("string").alias("source_system"), "loaded_at", F.lit(False).alias("_late"), F.lit(True).alias("_tick")))
    return rows.groupBy(F.col("source_system").alias("feed_name"), "_tick").agg(
        F.count(F.lit(1)).alias("record_count"), F.max("loaded_at").alias("last_loaded_at"), F.count_if(F.col("_late")).alias("late_records")
    ).withColumn("scope_object", F.lit(scope))


def start_liveness(
    stream: DataFrame, scope: str, thresholds: DataFrame, checkpoint: str,
    sink: Callable[[DataFrame, int], None], clock: Callable[[], AsOf], beat: DataFrame | None = None,
    arrived: str | None = None, late_after: str = "1 day", **trigger,
) -> StreamingQuery:
    """Grade the feeds after each micro-batch and hand the graded rows to ``sink``.

    A micro-batch runs when rows or ticks arrive. Every feed ever seen is graded in each, by ``clock``, so one that fell
    silent fails in time without a row of its own, if ``beat`` keeps ticking. Counts live in the checkpoint: a restart
    goes on from them and counts nothing twice.
    """

    def grade_batch(loads: DataFrame, epoch: int) -> None:
        rules = loads.sparkSession.createDataFrame(rule_rows, thresholds.schema)
        sink(grade_feeds(loads.filter(~F.col("_tick")).drop("_tick"), clock(), rules), epoch)

    # the rules are governed policy, a handful of rows, read once when the query starts
    rule_rows = thresholds.filter(F.col("scope_object") == scope).collect()
    return (
        feed_loads_stream(stream, scope, beat, arrived, late_after).writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint).foreachBatch(grade_batch)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
