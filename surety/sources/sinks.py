"""Where loaded tables and decision records are kept: Parquet, append or replace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from surety.model import SCOPES, Sources


def replace_sources(sources: Sources, folder: str) -> None:
    """Full, idempotent reload of the four tables (decision records are kept elsewhere).

    Tables are laid out by feed, so that reading or repairing one feed leaves
    the files of the others alone.
    """
    for name, df in sources.items():
        df.write.mode("overwrite").partitionBy("source_system").parquet(f"{folder}/{name}")


def stored_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A stored table, with the given schema where there is one.

    Folder names carry no types. With a schema a feed called ``0042`` stays
    text; without one, what Spark would make of folder names is not asked for.
    """
    reader = spark.read
    if schema is not None:
        return reader.schema(schema).parquet(path)
    files = reader.parquet(path)
    texts = {n: "string" for n in ("source_system", "trust_batch_id") if n in files.columns}
    fields = [T.StructField(f.name, T.StringType() if f.name in texts else f.dataType, f.nullable) for f in files.schema]
    return reader.schema(T.StructType(fields)).parquet(path)


def stored_sources(spark: SparkSession, folder: str) -> Sources:
    """The four tables as stored; feeds are text whatever they look like."""
    return Sources(**{name: stored_table(spark, f"{folder}/{name}") for name in SCOPES})


def bucket_sources(sources: Sources, folder: str, prefix: str, buckets: int) -> None:
    """Catalog tables bucketed and sorted by entity, for populations decided over and over.

    Reductions and joins by entity then need no exchange at all. A bucket is
    read by one task, so keep facts with a very hot entity in the plain layout.
    """
    for name, df in sources.items():
        (
            df.write.mode("overwrite").option("path", f"{folder}/{name}")
            .bucketBy(buckets, "applicant_id").sortBy("applicant_id").saveAsTable(f"{prefix}_{name}")
        )


def bucketed_sources(spark: SparkSession, prefix: str) -> Sources:
    return Sources(**{name: spark.table(f"{prefix}_{name}") for name in SCOPES})


BATCH_KEYS = ("decision_date", "trust_batch_id")


def append_batch(df: DataFrame, path: str) -> None:
    """Append, one directory per date and batch, so that reading either prunes to it."""
    df.write.mode("append").partitionBy(*BATCH_KEYS).parquet(path)


def replace_feeds(df: DataFrame, path: str) -> None:
    """Overwrite the feeds present in ``df`` and no others.

    Rows are staged first, so a job that loses executors or fails before its
    commit leaves the table as it was. The commit itself deletes and renames
    folder by folder and is not atomic: after a failure there, run it again.
    """
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_system").parquet(path)
    )
