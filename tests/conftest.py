from __future__ import annotations

import os
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from surety.model import seed_thresholds  # noqa: E402
from surety.plans.assess import redecide  # noqa: E402
from surety.session import configure  # noqa: E402
from surety.sources import generator  # noqa: E402
from surety.sources.offsets import apply_offsets, load_sources  # noqa: E402

AS_OF = "2024-03-01 23:30:00"


@pytest.fixture(scope="session")
def spark():
    session = (
        configure(SparkSession.builder.appName("tests"), 4)
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def thresholds(spark):
    return seed_thresholds(spark)


@pytest.fixture(scope="session")
def lending(spark):
    """The generated fixture: four feeds with planted defects, loaded at AS_OF."""
    return load_sources(generator.seed_sources(spark), AS_OF)


@pytest.fixture(scope="session")
def rounds(spark, thresholds, lending):
    """Decided, recovered, decided again half an hour later."""
    batch = apply_offsets(generator.late_batch(spark), AS_OF)
    return redecide(lending, batch, "BUREAU_TU", "AGENT", AS_OF, "2024-03-01 23:45:00", thresholds)


@pytest.fixture(scope="session")
def make(spark):
    """Small hand-written sources: make(debts=[...], incomes=..., ...) loaded at AS_OF."""
    from decimal import Decimal

    from surety.model import (
        SEED_APPLICANTS, SEED_INCOME, SEED_LIABILITIES, SEED_REPAYMENT, Sources, literal_rows,
    )

    def build(debts, incomes=(("A", "60000"),), applicants=("A",), repayments=(("A", 0),)):
        """debts: (id, applicant, type, balance, payment, feed, hours ago)"""
        money = lambda v: None if v is None else Decimal(v)
        seeds = Sources(
            applicants=literal_rows(spark, [
                (a, f"LN-{a}", f"Name {a}", "FULL_TIME", 1, Decimal("1000"), "AUTO", "CORE", 1)
                for a in applicants], SEED_APPLICANTS),
            income=literal_rows(spark, [
                (f"INC-{n}", row[0], money(row[1]), "TAX_RETURN", 1, "PAYROLL",
                 row[2] if len(row) > 2 else 1)
                for n, row in enumerate(incomes)], SEED_INCOME),
            liabilities=literal_rows(spark, [
                (i, a, t, "Lender", money(b), money(p), 1, f, h) for i, a, t, b, p, f, h in debts],
                SEED_LIABILITIES),
            repayment=literal_rows(spark, [
                (f"PAY-{n}", a, 24, m, 0, 1, "SERVICING", 1) for n, (a, m) in enumerate(repayments)],
                SEED_REPAYMENT),
        )
        return load_sources(seeds, AS_OF)

    return build


@pytest.fixture
def by():
    """Rows of a frame by key column."""
    return lambda df, key="applicant_id": {r[key]: SimpleNamespace(**r.asDict()) for r in df.collect()}
