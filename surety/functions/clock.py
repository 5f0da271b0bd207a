"""Ages and offsets against an explicit as-of instant."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

AsOf = str | datetime | Column


def instant(as_of: AsOf) -> Column:
    """``as_of`` as a timestamp column; text is read in the session time zone."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, (datetime, date)):
        as_of = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else as_of.isoformat()
    return F.lit(as_of).cast("timestamp")


def day_age(then: Column, as_of: AsOf) -> Column:
    """Calendar days crossed between ``then`` and ``as_of`` (23:59 to 00:01 is one)."""
    return F.datediff(F.to_date(instant(as_of)), F.to_date(then))


def hour_age(then: Column, as_of: AsOf) -> Column:
    """Clock hours crossed between ``then`` and ``as_of`` (00:59 to 01:01 is one)."""
    return F.timestamp_diff(
        "HOUR", F.date_trunc("HOUR", then), F.date_trunc("HOUR", instant(as_of))
    )


def second_age(then: Column, as_of: AsOf) -> Column:
    return F.unix_timestamp(instant(as_of)) - F.unix_timestamp(then)


def hours_before(as_of: AsOf, hours: Column) -> Column:
    return F.timestamp_add("HOUR", -hours, instant(as_of))


def days_before(as_of: AsOf, days: Column) -> Column:
    return F.date_sub(F.to_date(instant(as_of)), days)
