"""Metric model: figures defined once, queried by name at a chosen grain.

A metric is aggregated over its own table and aligned with the others on the
dimensions; child tables are never joined to each other, so nothing multiplies.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.clock import AsOf, day_age
from surety.operators.exposure import STALE_AFTER_DAYS


@dataclass(frozen=True)
class LogicalTable:
    name: str
    primary_key: str
    synonyms: tuple[str, ...] = ()
    comment: str = ""


@dataclass(frozen=True)
class Relationship:
    """Many rows of ``child`` refer to one row of ``parent`` by its primary key."""

    name: str
    child: str
    child_key: str
    parent: str


@dataclass(frozen=True)
class Dimension:
    name: str
    table: str
    column: str
    synonyms: tuple[str, ...] = ()
    comment: str = ""


@dataclass(frozen=True)
class Fact:
    """A row-level expression that metrics are built from."""

    name: str
    table: str
    expr: Callable[[AsOf], Column]
    comment: str = ""


@dataclass(frozen=True)
class Metric:
    """``how`` (sum, max or min) over a row-level ``value`` of one table."""

    name: str
    table: str
    how: str
    value: Callable[[AsOf], Column]
    synonyms: tuple[str, ...] = ()
    comment: str = ""


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class SemanticModel:
    tables: tuple[LogicalTable, ...]
    relationships: tuple[Relationship, ...]
    facts: tuple[Fact, ...]
    dimensions: tuple[Dimension, ...]
    metrics: tuple[Metric, ...]
    _names: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        for item in (*self.dimensions, *self.metrics):
            for name in (item.name, *item.synonyms):
                key = name.lower()
                if key in self._names:
                    raise ValueError(f"name used twice in the model: {name}")
                self._names[key] = item

    def resolve(self, name: str) -> Dimension | Metric:
        """A dimension or metric by name or synonym, alone or after its table's name or synonym and a dot."""
        key = name.lower()
        if key in self._names:
            return self._names[key]
        if "." in key:
            table, short = key.split(".", 1)
            item = self._names.get(short)
            if item is not None and item.table == self._table_named(table):
                return item
        raise KeyError(f"no dimension or metric called {name!r}")

    def _table_named(self, name: str) -> str | None:
        """A logical table by name or synonym."""
        return next((t.name for t in self.tables if name in (t.name.lower(), *(s.lower() for s in t.synonyms))), None)

    def describe(self) -> list[tuple[str, str, str, str]]:
        """(kind, table, name, comment) of everything in the model."""
        rows = [("table", t.name, t.name, t.comment) for t in self.tables]
        for kind, items in (("fact", self.facts), ("dimension", self.dimensions), ("metric", self.metrics)):
            rows += [(kind, i.table, i.name, i.comment) for i in items]
        return rows

    def _key_to(self, child: str, parent: str) -> str:
        for r in self.relationships:
            if r.child == child and r.parent == parent:
                return r.child_key
        raise ValueError(f"{child} has no relationship to {parent}")

    def query(
        self,
        data: dict[str, DataFrame],
        dimensions: Sequence[str],
        metrics: Sequence[str],
        as_of: AsOf,
        where: Column | str | None = None,
    ) -> DataFrame:
        """Metrics by dimensions; without dimensions, grand totals in one row.

        ``where`` filters the result, by its output names.
        """
        dims = [self.resolve(n) for n in dimensions]
        wanted = [self.resolve(n) for n in metrics]
        if not all(isinstance(d, Dimension) for d in dims):
            raise ValueError("only dimensions may be listed as dimensions")
        if not all(isinstance(m, Metric) for m in wanted):
            raise ValueError("only metrics may be listed as metrics")
        if not dims:
            if not wanted:
                raise ValueError("at least one dimension or metric is needed")
            return self._totals(data, wanted, as_of, where)
        parents = {r.parent for r in self.relationships}
        child_dims = {d.table for d in dims} - parents
        for table in child_dims:
            for other in {m.table for m in wanted} | child_dims:
                if other not in (table, *parents):
                    raise ValueError(f"a dimension of {table} cannot group a metric of {other}")
        if child_dims and {m.table for m in wanted} & parents:
            raise ValueError("a dimension of a child table cannot group a metric of its parent")

        names = [d.name for d in dims]
        combine = [_COMBINE[m.how](m.name).alias(m.name) for m in wanted]
        if child_dims:
            rows = self._one_table(data, child_dims.pop(), dims, wanted, as_of)
        else:
            rows = self._around_parent(data, dims, wanted, as_of)
        out = rows.groupBy(*names).agg(*combine) if wanted else rows.select(*names).distinct()
        return out.filter(where) if where is not None else out

    def _totals(
        self, data: dict[str, DataFrame], metrics: list[Metric], as_of: AsOf, where: Column | str | None
    ) -> DataFrame:
        """One row: each table is reduced to its own total first, and the single rows are stacked."""
        parts = []
        for table in sorted({m.table for m in metrics}):
            own = [m for m in metrics if m.table == table]
            rows = data[table].select(*[m.value(as_of).alias(m.name) for m in own])
            parts.append(rows.agg(*[_COMBINE[m.how](m.name).alias(m.name) for m in own]))
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        out = stacked.agg(*[F.max(m.name).alias(m.name) for m in metrics])
        return out.filter(where) if where is not None else out

    def _around_parent(
        self, data: dict[str, DataFrame], dims: list[Dimension], metrics: list[Metric], as_of: AsOf
    ) -> DataFrame:
        """Dimensions of one parent with metrics of any of its children.

        The children are stacked, not joined: a row carries its own table's
        values and NULL for the rest, and one grouping by the foreign key
        aligns them. The parent is then joined once; its unmatched rows stay
        (entities without children), and so do keys without a parent (their
        dimensions are NULL).
        """
        parent = dims[0].table
        if any(d.table != parent for d in dims):
            raise ValueError("dimensions of two parent tables cannot be combined")
        parent_key = next(t.primary_key for t in self.tables if t.name == parent)
        own = [m.value(as_of).alias(m.name) for m in metrics if m.table == parent]
        spine = data[parent].select(
            F.col(parent_key).alias("_pk"), *[F.col(d.column).alias(d.name) for d in dims], *own)
        parts = []
        for table in sorted({m.table for m in metrics} - {parent}):
            values = [m.value(as_of).alias(m.name) for m in metrics if m.table == table]
            parts.append(data[table].select(F.col(self._key_to(table, parent)).alias("_fk"), *values))
        if not parts:
            return spine
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        by_key = stacked.groupBy("_fk").agg(
            *[_COMBINE[m.how](m.name).alias(m.name) for m in metrics if m.table != parent])
        return spine.join(by_key, F.col("_pk") == F.col("_fk"), "full")

    def _one_table(
        self, data: dict[str, DataFrame], table: str, dims: list[Dimension],
        metrics: list[Metric], as_of: AsOf,
    ) -> DataFrame:
        """Dimensions of a child (and perhaps its parent) with metrics of that child.

        Rows are combined per foreign key and own dimensions first, which
        shrinks a hot key to a few rows before it meets the parent.
        """
        own = [F.col(d.column).alias(d.name) for d in dims if d.table == table]
        foreign = [d for d in dims if d.table != table]
        values = [m.value(as_of).alias(m.name) for m in metrics]
        if not foreign:
            return data[table].select(*own, *values)
        parent = foreign[0].table
        parent_key = next(t.primary_key for t in self.tables if t.name == parent)
        rows = data[table].select(F.col(self._key_to(table, parent)).alias("_fk"), *own, *values)
        keys = ["_fk", *[d.name for d in dims if d.table == table]]
        partial = (
            rows.groupBy(*keys).agg(*[_COMBINE[m.how](m.name).alias(m.name) for m in metrics])
            if metrics else rows.distinct()
        )
        side = data[parent].select(
            F.col(parent_key).alias("_fk"), *[F.col(d.column).alias(d.name) for d in foreign])
        return partial.join(side, "_fk", "left")


def _lending_model() -> SemanticModel:
    facts = (
        Fact("balance", "liabilities", lambda _: F.col("outstanding_balance"), "owed on one liability"),
        Fact("payment", "liabilities", lambda _: F.col("monthly_payment"), "due per month on one liability"),
        Fact("staleness_days", "liabilities", lambda t: day_age(F.col("loaded_at"), t),
             "age of the record in days"),
        Fact("annual_income", "income", lambda _: F.col("gross_annual_income"), "verified yearly income"),
        Fact("missed", "repayment", lambda _: F.col("missed_payments_12m"), "missed payments, 12 months"),
    )
    f = {x.name: x.expr for x in facts}

    def stale(as_of: AsOf) -> Column:
        old = f["staleness_days"](as_of) > STALE_AFTER_DAYS
        return F.when(old, f["balance"](as_of)).otherwise(F.lit(0).cast("decimal(12,2)"))

    # Names and synonyms by which the model is queried.
    return SemanticModel(
        tables=(
            LogicalTable("applicants", "applicant_id", ("borrowers", "loan applicants", "customers"),
                         "who is asking for credit"),
            LogicalTable("income", "income_record_id", ("verified income", "earnings"), "verified income"),
            LogicalTable("liabilities", "liability_id", ("debts", "obligations", "credit commitments"),
                         "what is already owed"),
            LogicalTable("repayment", "payment_record_id", ("payment history", "delinquency history"),
                         "how past debts were paid"),
        ),
        relationships=(
            Relationship("income_to_applicant", "income", "applicant_id", "applicants"),
            Relationship("liabilities_to_applicant", "liabilities", "applicant_id", "applicants"),
            Relationship("repayment_to_applicant", "repayment", "applicant_id", "applicants"),
        ),
        facts=facts,
        dimensions=(
            Dimension("applicant_id", "applicants", "applicant_id", ("customer id", "borrower id")),
            Dimension("applicant_name", "applicants", "full_name"),
            Dimension("employment_status", "applicants", "employment_status"),
            Dimension("loan_purpose", "applicants", "loan_purpose"),
            Dimension("application_date", "applicants", "application_date"),
            Dimension("liability_type", "liabilities", "liability_type", ("debt type",)),
            Dimension("source_feed", "liabilities", "source_system", ("bureau feed", "data source")),
        ),
        metrics=(
            Metric("outstanding_exposure", "liabilities", "sum", f["balance"],
                   ("total exposure", "total debt", "total balance owed"), "owed across all liabilities"),
            Metric("monthly_obligations", "liabilities", "sum", f["payment"],
                   ("monthly debt payments",), "due per month across all liabilities"),
            Metric("verified_annual_income", "income", "max", f["annual_income"],
                   ("income", "salary"), "verified yearly income"),
            Metric("missed_payments", "repayment", "max", f["missed"], (), "missed payments, 12 months"),
            Metric("worst_staleness_days", "liabilities", "max", f["staleness_days"],
                   ("data age", "oldest record age"), "age of the oldest contributing record"),
            Metric("stale_exposure", "liabilities", "sum", stale, (), "owed on records older than a week"),
        ),
    )


LENDING = _lending_model()
