"""Table contracts, governed thresholds and trust-tier tags."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
TOTAL = T.DecimalType(22, 2)     # sums of MONEY
PERCENT = T.DecimalType(18, 2)   # wider than the declared (7,2): see README, "Deviations"
MEASURE = T.DecimalType(14, 4)
INDEX = T.DecimalType(5, 2)


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


_S, _I, _D, _TS = T.StringType(), T.IntegerType(), T.DateType(), T.TimestampType()

# Holding tables: columns exactly as they arrive in the feed files (offsets, not dates).
SEED_APPLICANTS = _schema(
    ("applicant_id", _S, True), ("application_id", _S, True), ("full_name", _S, True),
    ("employment_status", _S, True), ("application_days_ago", _I, True),
    ("requested_amount", MONEY, True), ("loan_purpose", _S, True),
    ("source_system", _S, True), ("loaded_hours_ago", _I, True),
)
SEED_INCOME = _schema(
    ("income_record_id", _S, True), ("applicant_id", _S, True),
    ("gross_annual_income", MONEY, True), ("verification_method", _S, True),
    ("effective_days_ago", _I, True), ("source_system", _S, True), ("loaded_hours_ago", _I, True),
)
SEED_LIABILITIES = _schema(
    ("liability_id", _S, True), ("applicant_id", _S, True), ("liability_type", _S, True),
    ("creditor_name", _S, True), ("outstanding_balance", MONEY, True),
    ("monthly_payment", MONEY, True), ("effective_days_ago", _I, True),
    ("source_system", _S, True), ("loaded_hours_ago", _I, True),
)
SEED_REPAYMENT = _schema(
    ("payment_record_id", _S, True), ("applicant_id", _S, True), ("months_reviewed", _I, True),
    ("missed_payments_12m", _I, True), ("max_days_past_due", _I, True),
    ("effective_days_ago", _I, True), ("source_system", _S, True), ("loaded_hours_ago", _I, True),
)

# Source tables after loading; False = required.
APPLICANTS = _schema(
    ("applicant_id", _S, False), ("application_id", _S, False), ("full_name", _S, True),
    ("employment_status", _S, True), ("application_date", _D, True),
    ("requested_amount", MONEY, True), ("loan_purpose", _S, True),
    ("source_system", _S, False), ("loaded_at", _TS, False),
)
INCOME = _schema(
    ("income_record_id", _S, False), ("applicant_id", _S, False),
    ("gross_annual_income", MONEY, True), ("verification_method", _S, True),
    ("effective_date", _D, True), ("source_system", _S, False), ("loaded_at", _TS, False),
)
LIABILITIES = _schema(
    ("liability_id", _S, False), ("applicant_id", _S, False), ("liability_type", _S, True),
    ("creditor_name", _S, True), ("outstanding_balance", MONEY, True),
    ("monthly_payment", MONEY, True), ("effective_date", _D, True),
    ("source_system", _S, False), ("loaded_at", _TS, False),
)
REPAYMENT = _schema(
    ("payment_record_id", _S, False), ("applicant_id", _S, False), ("months_reviewed", _I, True),
    ("missed_payments_12m", _I, True), ("max_days_past_due", _I, True),
    ("effective_date", _D, True), ("source_system", _S, False), ("loaded_at", _TS, False),
)

# Declared text lengths, checked by sources.conformance (Spark strings carry none).
TEXT_LENGTHS = {
    "applicants": {
        "applicant_id": 20, "application_id": 20, "full_name": 120,
        "employment_status": 40, "loan_purpose": 40, "source_system": 40,
    },
    "income": {
        "income_record_id": 20, "applicant_id": 20, "verification_method": 40, "source_system": 40,
    },
    "liabilities": {
        "liability_id": 20, "applicant_id": 20, "liability_type": 40,
        "creditor_name": 120, "source_system": 40,
    },
    "repayment": {"payment_record_id": 20, "applicant_id": 20, "source_system": 40},
}

PARTNER_SIGNALS = _schema(
    ("signal_id", _S, False), ("scope_object", _S, True), ("feed_name", _S, True),
    ("record_identifier", _S, True), ("signal_name", _S, True), ("signal_dimension", _S, True),
    ("measured_value", MEASURE, True), ("data_trust_index", INDEX, True),
    ("trust_status", _S, True), ("is_blocking", T.BooleanType(), True),
    ("evaluated_at", _TS, True), ("detail", _S, True),
)

THRESHOLDS = _schema(
    ("signal_name", _S, False), ("signal_dimension", _S, False), ("scope_object", _S, True),
    ("warn_at", MONEY, True), ("fail_at", MONEY, True), ("unit", _S, True),
    ("is_blocking", T.BooleanType(), False), ("owner_team", _S, True), ("rationale", _S, True),
)

TAGS = _schema(
    ("object_name", _S, False), ("data_domain", _S, True), ("trust_tier", _S, True),
    ("decision_critical", _S, True),
)
EDGES = _schema(("object_name", _S, False), ("input_object", _S, False))

# --- Fixed values -----------------------------------------------------------
# Scope names, governed limits, signal names, tag domains and tiers. They must
# read as given for results to match; the rationale column is free text.
SCOPES = {
    "liabilities": "RAW.LIABILITIES",
    "income": "RAW.INCOME_VERIFICATION",
    "applicants": "RAW.APPLICANTS",
    "repayment": "RAW.REPAYMENT_HISTORY",
}
LIABILITY_STALENESS = "LIABILITY_FEED_STALENESS"
INCOME_COMPLETENESS = "INCOME_COMPLETENESS"
LIABILITY_UNIQUENESS = "LIABILITY_UNIQUENESS"
EMPLOYMENT_DOMAIN = ("FULL_TIME", "PART_TIME", "SELF_EMPLOYED", "CONTRACT")
THRESHOLD_ROWS = [
    # signal_name, dimension, scope, warn_at, fail_at, unit, is_blocking, owner, rationale
    ("LIABILITY_FEED_STALENESS", "TIMELINESS", "RAW.LIABILITIES", 3, 7, "days", True,
     "Credit Risk Data", "Daily feed: after a week new debts may be missing altogether."),
    ("INCOME_COMPLETENESS", "COMPLETENESS", "RAW.INCOME_VERIFICATION", 1, 1, "null records", True,
     "Credit Risk Data", "Without a verified income the debt ratio has no denominator."),
    ("LIABILITY_UNIQUENESS", "UNIQUENESS", "RAW.LIABILITIES", 1, 1, "duplicate records", True,
     "Credit Risk Data", "A debt counted twice inflates exposure and the debt ratio."),
    ("EMPLOYMENT_STATUS_VALIDITY", "VALIDITY", "RAW.APPLICANTS", 1, 3, "invalid values", False,
     "Onboarding Data", "Used for segments only; it does not enter the ratio."),
    ("LIABILITY_REFERENTIAL_INTEGRITY", "INTEGRITY", "RAW.LIABILITIES", 1, 1, "orphan records", False,
     "Credit Risk Data", "Distorts portfolio totals but belongs to no named applicant."),
    ("INCOME_FEED_STALENESS", "TIMELINESS", "RAW.INCOME_VERIFICATION", 7, 14, "days", True,
     "Credit Risk Data", "Weekly feed: after two weeks the job behind the figure may be gone."),
    ("APPLICANT_FEED_STALENESS", "TIMELINESS", "RAW.APPLICANTS", 2, 5, "days", False,
     "Onboarding Data", "Written once at submission, so age is only informative."),
    ("REPAYMENT_FEED_STALENESS", "TIMELINESS", "RAW.REPAYMENT_HISTORY", 7, 14, "days", True,
     "Credit Risk Data", "An old window can hide a recently missed payment."),
]
PROFILE_OBJECT = "SEMANTIC.V_APPLICANT_CREDIT_PROFILE"
DATA_DOMAINS = ("CREDIT_RISK", "CUSTOMER", "SERVICING")
TRUST_TIERS = ("CERTIFIED", "PROVISIONAL", "UNCERTIFIED")  # strongest to weakest
CRITICALITY = ("TRUE", "FALSE")
TAG_ROWS = [
    # object, data_domain, trust_tier, decision_critical
    ("RAW.LIABILITIES", "CREDIT_RISK", "PROVISIONAL", "TRUE"),
    ("RAW.INCOME_VERIFICATION", "CREDIT_RISK", "CERTIFIED", "TRUE"),
    ("RAW.APPLICANTS", "CUSTOMER", "CERTIFIED", "TRUE"),
    ("RAW.REPAYMENT_HISTORY", "SERVICING", "CERTIFIED", "TRUE"),
    (PROFILE_OBJECT, "CREDIT_RISK", "PROVISIONAL", "TRUE"),
]
INPUT_EDGES = [(PROFILE_OBJECT, scope) for scope in SCOPES.values()]
# --- End of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Sources:
    """The four source tables of one lending population."""

    applicants: DataFrame
    income: DataFrame
    liabilities: DataFrame
    repayment: DataFrame

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in SCOPES]

    def with_liabilities(self, liabilities: DataFrame) -> "Sources":
        return replace(self, liabilities=liabilities)

    def restrict(self, population: DataFrame) -> "Sources":
        """Keep only rows of the applicants listed in ``population(applicant_id)``."""
        ids = population.select("applicant_id")
        keep = {n: df.join(ids, "applicant_id", "left_semi") for n, df in self.items()}
        return Sources(**keep)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A local relation: its size is known to the planner and no job runs to produce it."""
    from decimal import Decimal

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    def typed(value, field: T.StructField):
        if value is None or not isinstance(field.dataType, T.DecimalType):
            return value
        return Decimal(str(value)).quantize(Decimal(1).scaleb(-field.dataType.scale))

    arrow = to_arrow_schema(schema)
    columns = [
        pa.array([typed(row[i], f) for row in rows], arrow.field(i).type) for i, f in enumerate(schema)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)


def seed_thresholds(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """The governed limits as a table, so that governance can swap in its own."""
    return literal_rows(spark, THRESHOLD_ROWS if rows is None else rows, THRESHOLDS)


def seed_tags(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return literal_rows(spark, TAG_ROWS if rows is None else rows, TAGS)


def input_edges(spark: SparkSession, edges: list[tuple] | None = None) -> DataFrame:
    return literal_rows(spark, INPUT_EDGES if edges is None else edges, EDGES)


def no_partner_signals(spark: SparkSession) -> DataFrame:
    """The partner hand-off table before the partner has delivered anything."""
    return literal_rows(spark, [], PARTNER_SIGNALS)
