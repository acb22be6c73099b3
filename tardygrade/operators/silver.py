"""Cleaning: status, departure clock, delay label, route and part of day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands, clock_hour, clock_minute, first_match, without_midnight_24

# Labels and edges of the derived columns.
COMPLETED = "Completed"
CANCELLED = "Cancelled"
DIVERTED = "Diverted"
PERIOD_EDGES = (6, 12, 18)
PERIOD_LABELS = ("Night", "Morning", "Afternoon", "Evening")


def flight_status(df: DataFrame) -> DataFrame:
    """Adds ``flight_status``; a missing flag counts as not set."""
    rules = [(F.col("cancelled") == 1, CANCELLED), (F.col("diverted") == 1, DIVERTED)]
    return df.withColumn("flight_status", first_match(rules, COMPLETED))


def decode_hhmm(df: DataFrame, col: str = "crs_dep_time") -> DataFrame:
    """Adds ``scheduled_dep_hour`` and ``scheduled_dep_minute`` of an HHMM column."""
    time = F.col(col)
    return df.withColumns({"scheduled_dep_hour": clock_hour(time), "scheduled_dep_minute": clock_minute(time)})


def clean_midnight(df: DataFrame, col: str = "crs_dep_time") -> DataFrame:
    """Adds ``<col>_clean`` with 2400 as 0 and decodes hour and minute from it."""
    clean = f"{col}_clean"
    return decode_hhmm(df.withColumn(clean, without_midnight_24(F.col(col))), clean)


def delay_label(df: DataFrame, col: str = "arr_delay", minutes: int = 15) -> DataFrame:
    """Adds ``is_delayed``: 1 from ``minutes`` on, 0 below, null without a delay."""
    return df.withColumn("is_delayed", (F.col(col) >= minutes).cast("int"))


def route_key(df: DataFrame, a: str = "origin", b: str = "dest") -> DataFrame:
    """Adds ``route``; a missing end is left out."""
    return df.withColumn("route", F.concat_ws("_", a, b))


def day_period(df: DataFrame, hour: str = "scheduled_dep_hour") -> DataFrame:
    """Adds ``departure_period``; an unknown hour falls into the last one."""
    label = bands(F.col(hour), PERIOD_EDGES, PERIOD_LABELS, null_label=PERIOD_LABELS[-1])
    return df.withColumn("departure_period", label)


def silver(df: DataFrame, delay_minutes: int = 15) -> DataFrame:
    """The cleaned trip table: the source columns and the seven derived ones."""
    steps = df.transform(flight_status).transform(clean_midnight).transform(delay_label, minutes=delay_minutes)
    steps = steps.transform(route_key).transform(day_period)
    derived = [
        "flight_status",
        "scheduled_dep_hour",
        "scheduled_dep_minute",
        "is_delayed",
        "crs_dep_time_clean",
        "route",
        "departure_period",
    ]
    return steps.select(*[c for c in df.columns if c not in derived], *derived)


def completed(df: DataFrame) -> DataFrame:
    """Trips that were neither cancelled nor diverted."""
    return df.filter(F.col("flight_status") == COMPLETED)
