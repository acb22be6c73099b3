"""Table contracts, feature lists and parameter presets."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names and types of the trip source table.
SOURCE_SCHEMA = T.StructType(
    [
        T.StructField("fl_date", T.DateType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("op_unique_carrier", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("origin_city_name", T.StringType()),
        T.StructField("origin_state_nm", T.StringType()),
        T.StructField("dest", T.StringType()),
        T.StructField("crs_dep_time", T.IntegerType()),
        T.StructField("dep_delay", T.DoubleType()),
        T.StructField("arr_delay", T.DoubleType()),
        T.StructField("taxi_out", T.DoubleType()),
        T.StructField("taxi_in", T.DoubleType()),
        T.StructField("air_time", T.DoubleType()),
        T.StructField("actual_elapsed_time", T.DoubleType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("cancelled", T.IntegerType()),
        T.StructField("diverted", T.IntegerType()),
        T.StructField("cancellation_code", T.StringType()),
        T.StructField("carrier_delay", T.DoubleType()),
        T.StructField("weather_delay", T.DoubleType()),
        T.StructField("nas_delay", T.DoubleType()),
        T.StructField("security_delay", T.DoubleType()),
        T.StructField("late_aircraft_delay", T.DoubleType()),
    ]
)

# The 32 columns of the first feature table, in order.
FEATURES_V1 = [
    "fl_date",
    "month",
    "day_of_week",
    "scheduled_dep_hour",
    "scheduled_dep_minute",
    "departure_period",
    "is_weekend",
    "dep_hour_sin",
    "dep_hour_cos",
    "month_sin",
    "month_cos",
    "op_unique_carrier",
    "origin",
    "dest",
    "route",
    "distance",
    "historical_route_flights",
    "reliable_route_delay_rate",
    "has_route_history",
    "historical_origin_flights",
    "reliable_origin_delay_rate",
    "has_origin_history",
    "historical_carrier_flights",
    "reliable_carrier_delay_rate",
    "has_carrier_history",
    "route_flights_last_7d",
    "route_delay_rate_last_7d",
    "origin_flights_last_7d",
    "origin_delay_rate_last_7d",
    "carrier_flights_last_7d",
    "carrier_delay_rate_last_7d",
    "is_delayed",
]

# The 21 columns the second feature table appends, in order.
FEATURES_V2_ADDED = [
    "historical_origin_hour_flights",
    "historical_origin_hour_delay_rate",
    "historical_route_hour_flights",
    "historical_route_hour_delay_rate",
    "historical_carrier_hour_flights",
    "historical_carrier_hour_delay_rate",
    "historical_origin_dow_flights",
    "historical_origin_dow_delay_rate",
    "historical_route_dow_flights",
    "historical_route_dow_delay_rate",
    "reliable_origin_hour_delay_rate",
    "reliable_route_hour_delay_rate",
    "reliable_carrier_hour_delay_rate",
    "reliable_origin_dow_delay_rate",
    "reliable_route_dow_delay_rate",
    "origin_hour_flights_last_7d",
    "origin_hour_delay_rate_last_7d",
    "route_hour_flights_last_7d",
    "route_hour_delay_rate_last_7d",
    "carrier_hour_flights_last_7d",
    "carrier_hour_delay_rate_last_7d",
]

FEATURES_V2 = FEATURES_V1 + FEATURES_V2_ADDED

# Categorical columns that get a training-frequency column.
CATEGORICAL = ["op_unique_carrier", "origin", "dest", "route"]

# Feature-table columns that are not model inputs.
NOT_MODEL_INPUTS = {"fl_date", "departure_period", "op_unique_carrier", "origin", "dest", "route", "is_delayed"}

# Model input order: the numeric columns of a feature table as they stand,
# with the frequency columns of the first model straight after the distance.
_V1_NUMERIC = [c for c in FEATURES_V1 if c not in NOT_MODEL_INPUTS]
_AFTER_DISTANCE = _V1_NUMERIC.index("distance") + 1
MODEL_FEATURES_V1 = (
    _V1_NUMERIC[:_AFTER_DISTANCE] + [f"{c}_frequency" for c in CATEGORICAL] + _V1_NUMERIC[_AFTER_DISTANCE:]
)
MODEL_FEATURES_V2 = _V1_NUMERIC + FEATURES_V2_ADDED

# Columns of the prediction table.
BUSINESS = ["fl_date", "op_unique_carrier", "origin", "dest", "route"]
PREDICTIONS = BUSINESS + [
    "scheduled_dep_hour",
    "distance",
    "is_delayed",
    "delay_probability",
    "predicted_delay",
    "risk_category",
]

# Delay-cause columns.
DELAY_CAUSES = ["carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay"]

# Decision thresholds that are swept, per use.
SWEEP_FOREST_V1 = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.50)
SWEEP_BOOSTED = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50)
SWEEP_FINAL = (0.25, 0.30, 0.35, 0.40, 0.45, 0.50)

# Percentiles of the probability profile.
PROFILE_PERCENTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


@dataclass(frozen=True)
class Preset:
    """Dates and volumes that depend on the data set."""

    train_end: date
    validation_end: date
    airport_min: int
    route_min: int
    carrier_test_min: int
    route_test_min: int
    preview_from: date
    reliable_min: int = 20
    delay_minutes: int = 15
    threshold: float = 0.40
    risk_edges: tuple[float, float] = (0.30, 0.50)


# Presets for a year of flights and for the test tables.
FLIGHTS_2024 = Preset(
    train_end=date(2024, 10, 1),
    validation_end=date(2024, 12, 1),
    airport_min=10_000,
    route_min=1_000,
    carrier_test_min=10_000,
    route_test_min=500,
    preview_from=date(2024, 2, 1),
)
TEST_TABLES = Preset(
    train_end=date(2000, 1, 1),
    validation_end=date(2001, 1, 1),
    airport_min=2_300,
    route_min=90,
    carrier_test_min=270,
    route_test_min=12,
    preview_from=date(1996, 2, 1),
)


class ContractError(ValueError):
    """The table lacks a column or has one of another kind."""


def _kind(data_type: T.DataType) -> str:
    return "number" if isinstance(data_type, T.NumericType) else data_type.typeName()


def check_contract(df: DataFrame, schema: T.StructType = SOURCE_SCHEMA) -> DataFrame:
    """Return ``df`` if it has every column of ``schema`` with the same kind of type.

    All numeric types count as one kind, so integer minutes pass for double ones.
    Only the schema is looked at; no job runs.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    faults = []
    for field in schema.fields:
        if field.name not in have:
            faults.append(f"{field.name}: missing")
        elif _kind(have[field.name]) != _kind(field.dataType):
            faults.append(f"{field.name}: {have[field.name].simpleString()}, not {field.dataType.simpleString()}")
    if faults:
        raise ContractError("; ".join(faults))
    return df
