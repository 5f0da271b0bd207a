"""A star-schema order book read as a lending population.

Customers are the applicants and orders their liabilities. Orders from before
``STALLED_BEFORE`` count as supplied by a feed that stopped 42 days ago.
Every table is projected whole; nothing is sampled or filtered away.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.functions.clock import AsOf
from surety.model import INDEX, MEASURE, MONEY, Sources
from surety.sources.offsets import apply_offsets, load_sources

AS_OF = "2024-03-01 23:30:00"
STALLED_BEFORE = "1995-03-01"
SEGMENT_DOMAIN = ("AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY")
NEW_LOAN_OFFSET = 10**12
SUPPLIER_OFFSET = 10**9  # suppliers apply too, under keys of their own; they owe nothing


# Columns used of each table, declared so that opening a table needs no look at its files.
_TABLES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_linenumber int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "documents": "doc_id bigint",
    "labels": "doc_id bigint",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{folder}/{name}.parquet")


def seeds(spark: SparkSession, folder: str) -> Sources:
    """Holding tables (offset columns) derived from customer, supplier and orders.

    Suppliers are applicants without a liability. Every seventh applicant has
    a second, newer income record, whose figure is missing for every other one.
    """
    customer = table(spark, folder, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment").unionByName(
        table(spark, folder, "supplier").select(
            (F.col("s_suppkey") + SUPPLIER_OFFSET).alias("c_custkey"), F.col("s_name").alias("c_name"),
            F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"),
            F.lit("BUILDING").alias("c_mktsegment")))
    orders = table(spark, folder, "orders")
    applicants = customer.selectExpr(
        "c_custkey AS applicant_id",
        "concat('LN-', c_custkey) AS application_id",
        "c_name AS full_name",
        "c_mktsegment AS employment_status",
        "cast(c_custkey % 14 AS int) AS application_days_ago",
        "cast(abs(cast(c_acctbal AS decimal(12,2))) AS decimal(12,2)) AS requested_amount",
        "element_at(array('MORTGAGE', 'REFINANCE', 'PERSONAL', 'AUTO'), c_nationkey % 4 + 1) AS loan_purpose",
        "'CORE_BANKING' AS source_system",
        "cast(c_custkey % 6 AS int) AS loaded_hours_ago",
    )
    income = customer.selectExpr(
        "concat('INC-', c_custkey) AS income_record_id",
        "c_custkey AS applicant_id",
        "CASE WHEN c_acctbal >= 0 THEN cast(cast(c_acctbal AS decimal(12,2)) * 50 AS decimal(12,2)) END"
        " AS gross_annual_income",
        "element_at(array('PAYROLL_FEED', 'TAX_RETURN', 'BANK_STATEMENT'), cast(c_custkey % 3 + 1 AS int))"
        " AS verification_method",
        "cast(c_custkey % 21 AS int) AS effective_days_ago",
        "'PAYROLL_VERIFY' AS source_system",
        "cast(c_custkey % 9 AS int) AS loaded_hours_ago",
    )
    second = customer.filter("c_custkey % 7 = 0").selectExpr(
        "concat('INC-', c_custkey, '-B') AS income_record_id",
        "c_custkey AS applicant_id",
        "cast(if(c_custkey % 2 = 0, null, 30000 + c_nationkey * 1000) AS decimal(12,2)) AS gross_annual_income",
        "'TAX_RETURN' AS verification_method",
        "0 AS effective_days_ago",
        "'PAYROLL_VERIFY' AS source_system",
        "0 AS loaded_hours_ago",
    )
    income = income.unionByName(second)
    stalled = f"o_orderdate < timestamp_ntz'{STALLED_BEFORE}'"
    balance = "cast(floor(o_totalprice / 1000) * 1000 AS decimal(12,2))"
    liabilities = orders.selectExpr(
        "o_orderkey AS liability_id",
        "o_custkey AS applicant_id",
        "o_orderpriority AS liability_type",
        "concat('Lender ', o_orderstatus) AS creditor_name",
        f"{balance} AS outstanding_balance",
        f"cast({balance} * 0.0004BD AS decimal(12,2)) AS monthly_payment",
        f"cast(if({stalled}, 42 + o_orderkey % 5, o_orderkey % 7) AS int) AS effective_days_ago",
        f"if({stalled}, 'BUREAU_TU', 'BUREAU_EQ') AS source_system",
        f"cast(if({stalled}, 1008, o_orderkey % 20) AS int) AS loaded_hours_ago",
    )
    repayment = customer.selectExpr(
        "concat('PAY-', c_custkey) AS payment_record_id",
        "c_custkey AS applicant_id",
        "24 AS months_reviewed",
        "cast(c_custkey % 4 AS int) AS missed_payments_12m",
        "cast(c_custkey % 5 * 15 AS int) AS max_days_past_due",
        "cast(c_custkey % 10 AS int) AS effective_days_ago",
        "'LOAN_SERVICING' AS source_system",
        "cast(216 + c_custkey % 12 AS int) AS loaded_hours_ago",
    )
    return Sources(applicants, income, liabilities, repayment)


def sources(spark: SparkSession, folder: str, as_of: AsOf = AS_OF) -> Sources:
    return load_sources(seeds(spark, folder), as_of)


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """The events table under the generic contract: a feed column and a load time."""
    return table(spark, folder, "events").select(
        "event_id",
        F.col("event_type").alias("source_system"),
        F.col("ts").cast("timestamp").alias("loaded_at"),
        "user_id", "value",
    )


def late_batch(spark: SparkSession, folder: str, as_of: AsOf = AS_OF) -> DataFrame:
    """The stalled feed's delayed delivery.

    It refreshes the feed's urgent loans and brings one new loan for each of
    them; the feed's other loans catch up later by update.
    """
    urgent = seeds(spark, folder).liabilities.filter(
        (F.col("source_system") == "BUREAU_TU") & (F.col("liability_type") == "1-URGENT")
    )
    balance, payment = F.col("outstanding_balance"), F.col("monthly_payment")

    def row(liability_id, kind, owed, monthly):
        return F.struct(liability_id.alias("liability_id"), kind.alias("liability_type"),
                        owed.cast(MONEY).alias("outstanding_balance"), monthly.cast(MONEY).alias("monthly_payment"))

    refreshed = row(F.col("liability_id"), F.col("liability_type"), balance - 500, payment)
    unseen = row(F.col("liability_id") + F.lit(NEW_LOAN_OFFSET), F.lit("6-LATE"), balance * F.lit(Decimal("0.5")), payment * 2)
    both = urgent.withColumn("row", F.explode(F.array(refreshed, unseen))).withColumns(
        {"effective_days_ago": F.lit(1), "loaded_hours_ago": F.lit(2),
         **{c: F.col(f"row.{c}") for c in ("liability_id", "liability_type", "outstanding_balance", "monthly_payment")}})
    return apply_offsets(both.drop("row"), as_of)


def correction_batch(spark: SparkSession, folder: str, as_of: AsOf) -> DataFrame:
    """A second late delivery: corrected balances of all urgent loans, of the late ones it brought too, and of high-priority ones."""
    seed = seeds(spark, folder).liabilities.filter(F.col("liability_type").isin("1-URGENT", "2-HIGH"))
    known = seed.select("*", F.lit(0).alias("shift")).unionByName(
        seed.filter((F.col("source_system") == "BUREAU_TU") & (F.col("liability_type") == "1-URGENT"))
        .withColumns({"shift": F.lit(NEW_LOAN_OFFSET), "liability_type": F.lit("6-LATE")}))
    return apply_offsets(known.withColumns({
        "liability_id": F.col("liability_id") + F.col("shift"),
        "outstanding_balance": (F.col("outstanding_balance") + 250).cast(MONEY),
        "effective_days_ago": F.lit(2), "loaded_hours_ago": F.lit(3)}).drop("shift"), as_of)


def report_lineage(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Reports built on reports, as tags and edges: one object per order, customer, nation, region, and the whole.

    An order's tier is that of its feed; everything built on it is declared CERTIFIED.
    """
    stalled = F.col("o_orderdate") < F.lit(STALLED_BEFORE).cast("timestamp_ntz")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", stalled.alias("stalled"), "o_orderstatus")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = spark.read.schema("n_nationkey int, n_regionkey int").parquet(f"{folder}/nation.parquet")

    def name(kind: str, key: str) -> Column:
        return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))

    def edge(df: DataFrame, upper: Column, lower: Column) -> DataFrame:
        return df.select(upper.alias("object_name"), lower.alias("input_object"))

    whole = F.lit("REPORT:ALL")
    edges = (
        edge(orders, name("CUSTOMER", "o_custkey"), name("ORDER", "o_orderkey"))
        .union(edge(customer, name("NATION", "c_nationkey"), name("CUSTOMER", "c_custkey")))
        .union(edge(nation, name("REGION", "n_regionkey"), name("NATION", "n_nationkey")))
        .union(edge(nation.select("n_regionkey").distinct(), whole, name("REGION", "n_regionkey")))
    )
    tier = F.when(F.col("stalled"), "UNCERTIFIED").when(F.col("o_orderstatus") == "P", "PROVISIONAL").otherwise("CERTIFIED")
    objects = (
        orders.select(name("ORDER", "o_orderkey").alias("object_name"), tier.alias("trust_tier"))
        .union(customer.select(name("CUSTOMER", "c_custkey"), F.lit("CERTIFIED")))
        .union(nation.select(name("NATION", "n_nationkey"), F.lit("CERTIFIED")))
        .union(nation.select(name("REGION", "n_regionkey"), F.lit("CERTIFIED")).distinct())
        .union(spark.range(1).select(whole, F.lit("CERTIFIED")))
    )
    return objects.withColumns({"data_domain": F.lit("CREDIT_RISK"), "decision_critical": F.lit("TRUE")}), edges


def partner_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as a partner's record-level assessments (the 12-column contract)."""
    kind, value = F.col("event_type"), F.col("value").cast("decimal(7,2)")
    return table(spark, folder, "events").select(
        F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("signal_id"),
        F.when(kind == "signup", "RAW.LIABILITIES").otherwise("RAW.APPLICANTS").alias("scope_object"),
        F.lit("PARTNER").alias("feed_name"),
        F.col("user_id").cast("string").alias("record_identifier"),
        F.concat(F.lit("RULE_"), F.upper(kind)).alias("signal_name"),
        F.lit("ACCURACY").alias("signal_dimension"),
        value.cast(MEASURE).alias("measured_value"),
        F.greatest(F.lit(Decimal("0.00")), 100 - value).cast(INDEX).alias("data_trust_index"),
        F.when(value >= 200, "FAIL").when(value >= 100, "WARN").otherwise("PASS").alias("trust_status"),
        kind.isin("error", "signup").alias("is_blocking"),
        F.col("ts").cast("timestamp").alias("evaluated_at"),
        F.concat(F.lit("value "), value.cast("string")).alias("detail"),
    )
