"""Declared-contract checks and row-count reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.model import APPLICANTS, INCOME, LIABILITIES, REPAYMENT, TEXT_LENGTHS, Sources

CONTRACTS = {
    "applicants": APPLICANTS, "income": INCOME, "liabilities": LIABILITIES, "repayment": REPAYMENT,
}


def conformance(df: DataFrame, table: str, contract: T.StructType, lengths: dict[str, int]) -> DataFrame:
    """Violations per (column, rule), all counted in one pass over the table."""
    checks = [(f.name, "NOT_NULL", F.col(f.name).isNull()) for f in contract if not f.nullable]
    checks += [
        (c, f"MAX_LENGTH_{n}", F.length(F.col(c).cast("string")) > n) for c, n in lengths.items()
    ]
    one_row = df.agg(*[F.count_if(bad).alias(f"c{i}") for i, (_, _, bad) in enumerate(checks)])
    entries = F.array(*[
        F.struct(
            F.lit(table).alias("table_name"), F.lit(col).alias("column_name"),
            F.lit(rule).alias("rule"), F.col(f"c{i}").alias("violations"),
        )
        for i, (col, rule, _) in enumerate(checks)
    ])
    return one_row.select(F.inline(entries))


def conformance_report(sources: Sources) -> DataFrame:
    parts = [conformance(df, n, CONTRACTS[n], TEXT_LENGTHS[n]) for n, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
