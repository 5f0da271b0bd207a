"""Session settings the operators are designed around."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The results rest on the time zone, so these are set whatever the cluster's defaults say.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key's side of a join also where a grouping on that key follows;
    # without it one task would stream all records of the hottest decision
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # plans here are built from many small expressions; do not record a call site for each
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder: SparkSession.Builder, local_cores: int | None = None) -> SparkSession.Builder:
    """Apply the defaults to a builder; ``local_cores`` is for tests and benches."""
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if local_cores:
        builder = (
            builder.master(f"local[{local_cores}]")
            .config("spark.sql.shuffle.partitions", str(local_cores))
            .config("spark.ui.enabled", "false")
        )
    return builder
