"""Holding tables (ages as offsets) to source tables (dates and instants)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.functions.clock import AsOf, days_before, hours_before
from surety.model import Sources

# offset column -> date column it becomes
_DAY_OFFSETS = {"application_days_ago": "application_date", "effective_days_ago": "effective_date"}


def apply_offsets(seed: DataFrame, as_of: AsOf) -> DataFrame:
    """Replace ``*_days_ago`` by a date and ``loaded_hours_ago`` by ``loaded_at``, in place."""
    out = []
    for name in seed.columns:
        if name in _DAY_OFFSETS:
            out.append(days_before(as_of, F.col(name)).alias(_DAY_OFFSETS[name]))
        elif name == "loaded_hours_ago":
            out.append(hours_before(as_of, F.col(name)).alias("loaded_at"))
        else:
            out.append(F.col(name))
    return seed.select(*out)


def load_sources(seeds: Sources, as_of: AsOf) -> Sources:
    return Sources(**{name: apply_offsets(df, as_of) for name, df in seeds.items()})
