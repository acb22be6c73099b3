"""The two feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import FEATURES_V1, FEATURES_V2
from ..functions import cycle, masked_rate, presence_flag, weekend_flag
from ..operators.history import ALL_ENTITIES, CONTEXT_ENTITIES, DAY_ENTITIES, Entity, attach_history


def calendar(df: DataFrame, weekend: Sequence[int] = (6, 7)) -> DataFrame:
    """Adds the weekend flag and hour and month on a circle; Monday is day 1."""
    hour_sin, hour_cos = cycle(F.col("scheduled_dep_hour"), 24)
    month_sin, month_cos = cycle(F.col("month"), 12)
    return df.withColumns(
        {
            "is_weekend": weekend_flag(F.col("day_of_week"), weekend),
            "dep_hour_sin": hour_sin,
            "dep_hour_cos": hour_cos,
            "month_sin": month_sin,
            "month_cos": month_cos,
        }
    )


def reliable(df: DataFrame, entities: Sequence[Entity], min_n: int = 20) -> DataFrame:
    """Adds each historical rate once more, null where it rests on fewer than ``min_n`` trips."""
    return df.withColumns(
        {
            f"reliable_{part.name}_delay_rate": masked_rate(F.col(part.columns[1]), F.col(part.columns[0]), min_n)
            for entity in entities
            for part in entity.parts
        }
    )


def has_history(df: DataFrame, entities: Sequence[Entity] = DAY_ENTITIES) -> DataFrame:
    """Adds a 0/1 flag per key that tells whether any trip on an earlier day exists."""
    return df.withColumns({f"has_{e.name}_history": presence_flag(F.col(e.columns[0])) for e in entities})


def _needed(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The columns that a feature table takes over, so that no others are shuffled."""
    return df.select(*[c for c in df.columns if c in features])


def features_v1(df: DataFrame, min_n: int = 20, dense: bool = False) -> DataFrame:
    """The 32-column feature table of completed, cleaned trips."""
    table = calendar(attach_history(_needed(df, FEATURES_V1), DAY_ENTITIES, dense=dense))
    return has_history(reliable(table, DAY_ENTITIES, min_n)).select(*FEATURES_V1)


def features_v2(df: DataFrame, min_n: int = 20, dense: bool = False) -> DataFrame:
    """The 53-column feature table of completed, cleaned trips, with all eight histories in one plan."""
    return from_histories_v2(histories_v2(df, dense), min_n)


def needed_v2(df: DataFrame) -> DataFrame:
    """The columns of trips that the second table depends on."""
    return _needed(df, FEATURES_V2)


def histories_v2(df: DataFrame, dense: bool = False) -> DataFrame:
    """The columns of the second table that do not follow from others of the same row: what to store of it."""
    return attach_history(needed_v2(df), ALL_ENTITIES, dense=dense)


def _late(names: Sequence[str]) -> dict[str, str]:
    """The columns that hold late trips in place of rates."""
    return {rate: rate.replace("_delay_rate", "_late") for rate in names}


def _rates() -> dict[str, str]:
    """Rate columns of all histories with their counts."""
    names = [c for e in ALL_ENTITIES for part in e.parts for c in part.columns]
    return dict(zip(names[1::2], names[::2]))


def with_late(table: DataFrame) -> DataFrame:
    """``histories_v2`` with late trips in place of rates: whole numbers that repeat, which take less room when they are stored."""
    rates = _rates()
    late = {c: F.rint(F.col(c) * F.col(n)).cast("long") for c, n in rates.items()}
    return table.withColumns(late).withColumnsRenamed(_late(list(rates)))


def with_rates(table: DataFrame) -> DataFrame:
    """``histories_v2`` back from ``with_late``: the same quotients of the same whole numbers."""
    rates = _rates()
    late = _late(list(rates))
    found = {late[c]: F.try_divide(F.col(late[c]).cast("double"), F.col(n).cast("double")) for c, n in rates.items()}
    return table.withColumns(found).withColumnsRenamed({name: c for c, name in late.items()})


def from_histories_v2(table: DataFrame, min_n: int = 20, keep: Sequence[str] = ()) -> DataFrame:
    """The 53-column table from ``histories_v2``, row by row, and behind them those columns to keep that it lacks."""
    whole = has_history(reliable(calendar(table), ALL_ENTITIES, min_n))
    return whole.select(*FEATURES_V2, *[c for c in keep if c not in FEATURES_V2])


def extend_v1(features: DataFrame, min_n: int = 20, dense: bool = False) -> DataFrame:
    """The 53-column table from a stored 32-column one."""
    table = attach_history(features, CONTEXT_ENTITIES, dense=dense)
    return reliable(table, CONTEXT_ENTITIES, min_n).select(*FEATURES_V2)
