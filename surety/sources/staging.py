"""Tables staged between the rounds of an iterative operator: lineage ends there, and a lost executor loses nothing."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, which driver and executors share.

    Without the setting a local session uses a temporary folder; on a cluster
    each executor would write to its own disk, so there it is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "surety-staging")


def staged(df: DataFrame) -> DataFrame:
    """The rows written as Parquet and read back."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
