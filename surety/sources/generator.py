"""Deterministic feed builders: modular arithmetic over a sequence, planted defects.

Each builder takes the sequence as a DataFrame, so it scales by handing it a
longer ``spark.range`` (or any table with an index column); nothing is built
on the driver except the handful of planted rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.model import (
    MONEY, SEED_APPLICANTS, SEED_INCOME, SEED_LIABILITIES, SEED_REPAYMENT, Sources,
    literal_rows,
)

# --- Fixed values: word lists, domains, rates and planted rows --------------
FIRST_NAMES = ["Alice", "Brian", "Chloe", "Daniel", "Elena", "Farid", "Grace", "Hiro", "Imani",
               "Jonas", "Katya", "Liam"]
LAST_NAMES = ["Abara", "Bennett", "Costa", "Duarte", "Ellis", "Fontaine", "Grant", "Haddad",
              "Iqbal", "Jensen"]
EMPLOYMENT = ["FULL_TIME", "PART_TIME", "SELF_EMPLOYED", "CONTRACT"]
PURPOSES = ["MORTGAGE", "REFINANCE", "PERSONAL", "AUTO"]
METHODS = ["PAYROLL_FEED", "TAX_RETURN", "BANK_STATEMENT"]
CREDITORS = ["Northwind Bank", "Harbour Credit Union", "Meridian Finance", "Calder Trust",
             "Ardent Lending"]
# type: (base, multiplier, modulus, monthly rate); balance = base + (i * multiplier % modulus) * 1000
DEBTS = {
    "MORTGAGE": (180000, 4523, 340, "0.0062"),
    "CREDIT_CARD": (500, 2711, 18, "0.0350"),
    "AUTO_LOAN": (6000, 3137, 42, "0.0210"),
    "PERSONAL_LOAN": (2000, 1949, 33, "0.0280"),
    "STUDENT_LOAN": (5000, 5281, 85, "0.0110"),
}
LIVE_FEED, STALLED_FEED, STALLED_HOURS = "BUREAU_EQ", "BUREAU_TU", 42 * 24
BAD_EMPLOYMENT_AT, BAD_EMPLOYMENT = (17, 38), "F/T"
NO_INCOME_AT = (23, 51)
WORKED_EXAMPLE = 42  # this applicant's rows are written out below
EXAMPLE_APPLICANT = ("APP-10042", "LN-90042", "Marcus Webb", "FULL_TIME", 2, "45000.00", "PERSONAL",
                     "CORE_BANKING", 3)
EXAMPLE_INCOME = ("INC-50042", "APP-10042", "128000.00", "PAYROLL_FEED", 4, "PAYROLL_VERIFY", 5)
EXAMPLE_REPAYMENT = ("PAY-30042", "APP-10042", 24, 0, 0, 2, "LOAN_SERVICING", 7)
EXAMPLE_DEBTS = [
    ("LIA-80042", "APP-10042", "MORTGAGE", "Northwind Bank", "410000.00", "2950.00", 44, "BUREAU_TU", 1008),
    ("LIA-80043", "APP-10042", "CREDIT_CARD", "Harbour Credit Union", "11500.00", "460.00", 1, "BUREAU_EQ", 6),
]
DUPLICATE_OF, DUPLICATE_ID = "LIA-70001", "LIA-79901"
ORPHAN_DEBT = ("LIA-79902", "APP-99999", "PERSONAL_LOAN", "Ardent Lending", "18000.00", "504.00", 3,
               "BUREAU_EQ", 8)
LATE_BATCH = [
    ("LIA-80042", "APP-10042", "MORTGAGE", "Northwind Bank", "406800.00", "2950.00", 1, "BUREAU_TU", 2),
    ("LIA-80044", "APP-10042", "AUTO_LOAN", "Meridian Finance", "34500.00", "725.00", 1, "BUREAU_TU", 2),
    ("LIA-80045", "APP-10042", "PERSONAL_LOAN", "Ardent Lending", "41000.00", "1215.00", 1, "BUREAU_TU", 2),
]
# --- End of fixed values ----------------------------------------------------


def _pick(words: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index % len(words) + 1).cast("int"))


def _numbered(prefix: str, base: int, index: Column) -> Column:
    return F.concat(F.lit(prefix), (index + base).cast("string"))


def applicants(index: DataFrame) -> DataFrame:
    """``index(i)`` with i from 1; the worked example is left out."""
    i = F.col("i")
    return index.filter(i != WORKED_EXAMPLE).select(
        _numbered("APP-", 10000, i).alias("applicant_id"),
        _numbered("LN-", 90000, i).alias("application_id"),
        F.concat_ws(" ", _pick(FIRST_NAMES, i * 7), _pick(LAST_NAMES, i * 3)).alias("full_name"),
        F.when(i.isin(*BAD_EMPLOYMENT_AT), BAD_EMPLOYMENT).otherwise(_pick(EMPLOYMENT, i * 5))
        .alias("employment_status"),
        (i % 14).cast("int").alias("application_days_ago"),
        (15000 + i * 7919 % 86 * 1000).cast(MONEY).alias("requested_amount"),
        _pick(PURPOSES, i * 11).alias("loan_purpose"),
        F.lit("CORE_BANKING").alias("source_system"),
        (i % 6).cast("int").alias("loaded_hours_ago"),
    )


def income(index: DataFrame) -> DataFrame:
    i = F.col("i")
    return index.filter(i != WORKED_EXAMPLE).select(
        _numbered("INC-", 50000, i).alias("income_record_id"),
        _numbered("APP-", 10000, i).alias("applicant_id"),
        F.when(~i.isin(*NO_INCOME_AT), 52000 + i * 6421 % 120 * 1000).cast(MONEY)
        .alias("gross_annual_income"),
        _pick(METHODS, i * 5).alias("verification_method"),
        (i % 21).cast("int").alias("effective_days_ago"),
        F.lit("PAYROLL_VERIFY").alias("source_system"),
        (i % 9).cast("int").alias("loaded_hours_ago"),
    )


def repayment(index: DataFrame) -> DataFrame:
    i = F.col("i")
    return index.filter(i != WORKED_EXAMPLE).select(
        _numbered("PAY-", 30000, i).alias("payment_record_id"),
        _numbered("APP-", 10000, i).alias("applicant_id"),
        F.lit(24).alias("months_reviewed"),
        (i * 3 % 4).cast("int").alias("missed_payments_12m"),
        (i * 17 % 5 * 15).cast("int").alias("max_days_past_due"),
        (i % 10).cast("int").alias("effective_days_ago"),
        F.lit("LOAN_SERVICING").alias("source_system"),
        (i % 12).cast("int").alias("loaded_hours_ago"),
    )


def liabilities(grid: DataFrame) -> DataFrame:
    """``grid(i, applicant_idx, slot)``: two or three debts per applicant, every third stalled."""
    i = F.col("i")
    kinds = list(DEBTS)
    balance = F.lit(None).cast("long")
    rate = F.lit(None).cast("decimal(5,4)")
    for kind, (base, mult, mod, monthly) in DEBTS.items():
        here = F.col("liability_type") == kind
        balance = F.when(here, base + i * mult % mod * 1000).otherwise(balance)
        rate = F.when(here, F.lit(Decimal(monthly)).cast("decimal(5,4)")).otherwise(rate)
    stalled = F.col("source_system") == STALLED_FEED
    return (
        grid.filter((F.col("applicant_idx") != WORKED_EXAMPLE)
                    & ~((F.col("slot") == 2) & (F.col("applicant_idx") % 4 == 0)))
        .withColumn("liability_type", _pick(kinds, i * 13))
        .withColumn("source_system", F.when(i % 3 == 0, STALLED_FEED).otherwise(LIVE_FEED))
        .withColumn("outstanding_balance", balance.cast(MONEY))
        .select(
            _numbered("LIA-", 70000, i).alias("liability_id"),
            _numbered("APP-", 10000, F.col("applicant_idx")).alias("applicant_id"),
            "liability_type",
            _pick(CREDITORS, i * 7).alias("creditor_name"),
            "outstanding_balance",
            F.round(F.col("outstanding_balance") * rate, 2).cast(MONEY).alias("monthly_payment"),
            F.when(stalled, 42 + i % 5).otherwise(i % 7).cast("int").alias("effective_days_ago"),
            "source_system",
            F.when(stalled, STALLED_HOURS).otherwise(i % 20).cast("int").alias("loaded_hours_ago"),
        )
    )


def seed_sources(spark: SparkSession, entities: int = 60) -> Sources:
    """The four feeds with their planted defects, as holding tables."""
    index = spark.range(entities).select((F.col("id") + 1).alias("i"))
    grid = spark.range(3 * entities).select(
        (F.col("id") + 1).alias("i"),
        (F.col("id") % entities + 1).alias("applicant_idx"),
        F.floor(F.col("id") / entities).alias("slot"),
    )
    return planted(spark, index, grid)


def planted(spark: SparkSession, index: DataFrame, grid: DataFrame) -> Sources:
    """The feeds over ``index(i)`` and ``grid(i, applicant_idx, slot)``, with example, duplicate and orphan."""
    debts = liabilities(grid)
    copy = debts.filter(F.col("liability_id") == DUPLICATE_OF).withColumn("liability_id", F.lit(DUPLICATE_ID))
    return Sources(
        applicants=applicants(index).unionByName(literal_rows(spark, [EXAMPLE_APPLICANT], SEED_APPLICANTS)),
        income=income(index).unionByName(literal_rows(spark, [EXAMPLE_INCOME], SEED_INCOME)),
        liabilities=debts.unionByName(copy).unionByName(
            literal_rows(spark, [*EXAMPLE_DEBTS, ORPHAN_DEBT], SEED_LIABILITIES)),
        repayment=repayment(index).unionByName(literal_rows(spark, [EXAMPLE_REPAYMENT], SEED_REPAYMENT)),
    )


def late_batch(spark: SparkSession) -> DataFrame:
    """What the stalled feed had failed to send, as a holding table."""
    return literal_rows(spark, LATE_BATCH, SEED_LIABILITIES)
