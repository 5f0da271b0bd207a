"""Feeds read line by line: good rows are loaded, bad ones set aside with every reason, and none is lost.

The strict reader (:func:`surety.sources.csv_feed.read_feed`) stops a load at its first bad row. Here each line is split
into texts first; then one pass judges every column by the declared contract, so a reject says all that is wrong with it:

    COLUMN_COUNT                the line does not have the declared number of fields, or its quotes do not match
    TYPE:<column>               the text is not of the declared type
    NOT_NULL:<column>           a required field is empty
    MAX_LENGTH:<column>         the text is longer than declared
    DOMAIN:<column>             the text is none of the accepted ones
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.model import TEXT_LENGTHS
from surety.sources.conformance import CONTRACTS
from surety.sources.csv_feed import _FORMAT, FEED_FILES

_LINE = "_line"
_PARSE = {**_FORMAT, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _LINE}


@dataclass(frozen=True)
class Judged:
    """``good``: typed rows of the feed. ``rejects``: line and its sorted reasons. Together all lines of the feed."""

    good: DataFrame
    rejects: DataFrame


def _texts(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


def _typed(field: T.StructField) -> Column:
    return F.col(f"_f.{field.name}").try_cast(field.dataType)


def _reasons(schema: T.StructType, required: Sequence[str], lengths: Mapping[str, int], domains: Mapping[str, Sequence[str]]) -> Column:
    whole = F.col("_f._bad").isNull()
    checks = [F.when(~whole, "COLUMN_COUNT")]
    for f in schema:
        text = F.col(f"_f.{f.name}")
        if not isinstance(f.dataType, T.StringType):
            checks.append(F.when(whole & text.isNotNull() & _typed(f).isNull(), f"TYPE:{f.name}"))
        if f.name in required:
            checks.append(F.when(whole & text.isNull(), f"NOT_NULL:{f.name}"))
        if f.name in lengths:
            checks.append(F.when(whole & (F.length(text) > lengths[f.name]), f"MAX_LENGTH:{f.name}"))
        if f.name in domains:
            checks.append(F.when(whole & ~text.isin(*domains[f.name]), f"DOMAIN:{f.name}"))
    return F.sort_array(F.array_compact(F.array(*checks)))


def judge_lines(
    lines: DataFrame, schema: T.StructType, required: Sequence[str] = (), lengths: Mapping[str, int] | None = None,
    domains: Mapping[str, Sequence[str]] | None = None,
) -> Judged:
    """Good rows and rejects of a frame with one column ``line``, a line of the feed format without its header.

    An empty field is a missing one. An empty or null line is a reject (COLUMN_COUNT). Lines that repeat are each judged.
    """
    ddl = ", ".join(f"`{f.name}` string" for f in schema)
    parsed = F.from_csv("line", f"{ddl}, {_LINE} string", _PARSE)
    text = F.coalesce("line", F.lit(""))
    fields = F.struct(*[parsed[f.name].alias(f.name) for f in schema],
                      F.when((text == "") | parsed.isNull() | parsed[_LINE].isNotNull(), True).alias("_bad"))
    judged = lines.select("line", fields.alias("_f")).withColumn("_why", _reasons(schema, required, lengths or {}, domains or {}))
    return Judged(
        judged.filter(F.size("_why") == 0).select(*[_typed(f).alias(f.name) for f in schema]),
        judged.filter(F.size("_why") > 0).select("line", F.col("_why").alias("reasons")))


def read_judged(spark: SparkSession, path: str, schema: T.StructType, **rules) -> Judged:
    """As :func:`judge_lines`, for the files of a feed, each with a header line.

    Fields may not hold line breaks, as a line is the unit that is set aside.
    """
    header = ",".join(schema.names)
    unquoted = F.replace(F.lower("value"), F.lit('"'), F.lit(""))
    lines = spark.read.text(path).filter(unquoted != header).select(F.col("value").alias("line"))
    return judge_lines(lines, schema, **rules)


def contract_rules(table: str) -> dict:
    """Required columns and text lengths that the table's contract declares, as far as its feed file holds them."""
    names = set(FEED_FILES[table][1].names)
    return {"required": [f.name for f in CONTRACTS[table] if not f.nullable and f.name in names], "lengths": TEXT_LENGTHS[table]}


def reject_counts(rejects: DataFrame) -> DataFrame:
    """How often each reason occurs; a line with several counts for each."""
    return rejects.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))
