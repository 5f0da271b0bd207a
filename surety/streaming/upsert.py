"""Extension: late batches merged into the stored table as they arrive."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from surety.plans.assess import append_late, late_path

_LEDGER = "stream string, epoch long, version long"


def ledger_path(path: str) -> str:
    """Where it is written down which micro-batch of which stream became which version of the table at ``path``."""
    return f"{path.rstrip('/')}_ledger"


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def version_of(spark: SparkSession, path: str, stream: str, epoch: int) -> int:
    """The version of a micro-batch: above all versions there are, and the same again when the batch is replayed.

    The choice is written down before any row of the batch is. Should two
    streams choose one number at a time, the later name chooses again.
    """
    while True:
        ledger = _rows(spark, ledger_path(path), _LEDGER)
        own = ledger.filter((F.col("stream") == stream) & (F.col("epoch") == epoch)).agg(F.max("version")).first()[0]
        if own is not None:
            rivals = ledger.filter((F.col("version") == own) & (F.col("stream") < stream)).count()
            if not rivals:
                return own
        # versions kept before there was a ledger, or outside of it, are folder names: no file is opened for them
        kept = _rows(spark, late_path(path), "version long").agg(F.max("version")).first()[0]
        listed = ledger.agg(F.max("version")).first()[0]
        highest = max((v for v in (kept, listed) if v is not None), default=-1)
        spark.createDataFrame([(stream, epoch, highest + 1)], _LEDGER).coalesce(1).write.mode("append").parquet(ledger_path(path))


def _stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave the stream when it made the checkpoint: kept over restarts, new with a new checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def start_late_upserts(
    stream: DataFrame, path: str, checkpoint: str, event_time: str | None = None, within: str = "1 day", **trigger
) -> StreamingQuery:
    """Keep every micro-batch as a version beside the liabilities table at ``path``.

    Read the table with :func:`surety.plans.assess.current_liabilities`. An
    epoch writes its own rows and nothing else; replayed after a failure, it
    appends the same version again, which changes nothing that is read.
    Versions rise over all streams that feed the table and over new
    checkpoints, so the figures that came last win. Rows that repeat whole
    within a micro-batch count once; with ``event_time``, rows of one key and
    time that come again ``within`` that time are left out.
    """
    if event_time is not None:
        stream = stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["liability_id", event_time])

    def merge_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        append_late(batch.dropDuplicates(), path, version_of(spark, path, _stream_name(spark, checkpoint), epoch))

    return (
        stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge_batch)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
