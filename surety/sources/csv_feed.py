"""CSV feeds in and out.

Format: header row, comma, double-quoted text, an empty field is NULL, and the
read stops at the first row that does not fit the declared schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.functions.clock import AsOf
from surety.model import (
    SEED_APPLICANTS, SEED_INCOME, SEED_LIABILITIES, SEED_REPAYMENT, Sources,
)
from surety.sources.offsets import apply_offsets, load_sources

_FORMAT = {"sep": ",", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "", "mode": "FAILFAST"}

FEED_FILES = {
    "applicants": ("applicants.csv", SEED_APPLICANTS),
    "income": ("income_verification.csv", SEED_INCOME),
    "liabilities": ("liabilities.csv", SEED_LIABILITIES),
    "repayment": ("repayment_history.csv", SEED_REPAYMENT),
}


def read_feed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One feed with its declared schema; nothing is inferred, a bad row aborts."""
    return (
        spark.read.schema(schema).options(header="true", enforceSchema="true", **_FORMAT).csv(path)
    )


def read_sources(spark: SparkSession, folder: str, as_of: AsOf) -> Sources:
    seeds = {n: read_feed(spark, f"{folder}/{f}", s) for n, (f, s) in FEED_FILES.items()}
    return load_sources(Sources(**seeds), as_of)


def read_late_batch(spark: SparkSession, path: str, as_of: AsOf) -> DataFrame:
    return apply_offsets(read_feed(spark, path, SEED_LIABILITIES), as_of)


def write_feed(df: DataFrame, path: str, order_by: str) -> None:
    """Ordered, quoted, overwriting export to a folder of part files.

    Sorting range-partitions the rows, so the parts follow one another in
    order and each is written by its own task.
    """
    df.orderBy(order_by).write.mode("overwrite").options(
        header="true", quote='"', escape='"', nullValue="", emptyValue="", quoteAll="true"
    ).csv(path)


def as_csv_line(*columns: Column) -> Column:
    """One record as a line of the feed format."""
    return F.to_csv(F.struct(*columns), {"quote": '"', "escape": '"', "nullValue": ""})


def from_csv_line(line: Column, schema: T.StructType) -> Column:
    """One line of the feed format as a struct; a bad line aborts."""
    return F.from_csv(line, schema.simpleString()[len("struct<"):-1].replace(":", " "), _FORMAT)
