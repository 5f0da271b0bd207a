"""Guarded ratios in decimal arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surety.model import PERCENT


def percent(part: Column, whole: Column) -> Column:
    """``part / whole`` in per cent to two places, half-up; NULL unless whole > 0.

    Scaling the numerator first keeps eleven digits after the point through the
    division, so the rounding to two places is the only one that shows.
    """
    return F.when(whole > 0, F.round(part * 100 / F.nullif(whole, F.lit(0)), 2)).cast(PERCENT)


def share(part: Column, whole: Column) -> Column:
    """As :func:`percent`, but undefined only where ``whole`` is zero or missing."""
    return F.round(part * 100 / F.nullif(whole, F.lit(0)), 2).cast(PERCENT)


def annual_percent(monthly: Column, yearly: Column) -> Column:
    """Twelve monthly amounts as a percentage of a yearly one."""
    return F.when(yearly > 0, F.round(monthly * 1200 / F.nullif(yearly, F.lit(0)), 2)).cast(PERCENT)
