"""Calendar and clock arithmetic. Nothing here depends on the session time zone."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_midnight_24(hhmm: Column) -> Column:
    """Midnight written as 2400 becomes 0."""
    return F.when(hhmm == 2400, F.lit(0)).otherwise(hhmm)


def clock_hour(hhmm: Column) -> Column:
    """Hour of an HHMM number, truncated toward zero."""
    return (hhmm / 100).cast("int")


def clock_minute(hhmm: Column) -> Column:
    """Minute of an HHMM number; takes the sign of the number."""
    return (hhmm % 100).cast("int")


def weekend_flag(day_of_week: Column, days: Sequence[int] = (6, 7)) -> Column:
    """1 on the given days, else 0, also for a null day."""
    return F.coalesce(day_of_week.isin(*days).cast("int"), F.lit(0))


def cycle(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of ``value`` on a circle of ``period`` steps."""
    angle = value * (2 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def epoch_seconds(day: Column, hour: Column, minute: Column) -> Column:
    """Seconds since 1970-01-01 00:00 UTC, as a long."""
    return F.unix_date(day).cast("long") * 86_400 + hour * 3_600 + minute * 60
