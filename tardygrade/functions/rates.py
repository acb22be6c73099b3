"""Guarded ratios and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """``part / whole`` where ``whole`` is positive, else null."""
    return F.when(whole > 0, part / whole)


def masked_rate(value: Column, support: Column, minimum: int) -> Column:
    """``value`` where it rests on at least ``minimum`` rows, else null."""
    return F.when(support >= minimum, value)


def presence_flag(support: Column) -> Column:
    """1 where there is any support, else 0, also for null."""
    return F.coalesce((support > 0).cast("int"), F.lit(0))


def percent(fraction: Column, digits: int = 2) -> Column:
    """A fraction as a rounded percentage."""
    return F.round(fraction * 100, digits)


def zero_safe(part: Column, whole: Column) -> Column:
    """``part / whole``, or 0 where ``whole`` is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))
