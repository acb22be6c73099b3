"""Group statistics of delays, delay causes and longest delays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import DELAY_CAUSES
from ..functions import bands, percent
from .quantiles import grouped_medians

# Distance ranges.
DISTANCE_EDGES = (500, 1000, 1500, 2500)
DISTANCE_LABELS = ("<500", "500-999", "1000-1499", "1500-2499", "2500+")


def group_stats(
    df: DataFrame,
    keys: Sequence[str],
    delay: str = "arr_delay",
    label: str = "is_delayed",
    *,
    median: bool = False,
    min_rows: int = 0,
    top: int | None = None,
) -> DataFrame:
    """Rows, mean delay, share of delayed trips and optionally the exact median delay per group.

    Groups with fewer than ``min_rows`` rows are left out; ``top`` keeps the groups
    with the highest share. The median is that of ``grouped_medians``, for which ``df`` is
    read once more; the measure may have any number of distinct values.
    """
    measures = [F.count("*").alias("flights"), F.round(F.avg(delay), 2).alias(f"avg_{delay}")]
    measures.append(percent(F.avg(label)).alias("delay_rate_pct"))
    table = df.groupBy(*keys).agg(*measures)
    if median:
        name = f"median_{delay}"
        medians = grouped_medians(df, keys, delay, name).withColumnsRenamed({k: f"_{k}" for k in keys})
        table = table.join(medians, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
        table = table.select(*keys, "flights", f"avg_{delay}", F.round(name, 2).alias(name), "delay_rate_pct")
    if min_rows:
        table = table.filter(F.col("flights") >= min_rows)
    table = table.orderBy(F.desc("delay_rate_pct"), *keys)
    return table if top is None else table.limit(top)


def distance_bucket(df: DataFrame) -> DataFrame:
    """Adds ``distance_bucket``; an unknown distance falls into the last one."""
    label = bands(F.col("distance"), DISTANCE_EDGES, DISTANCE_LABELS, null_label=DISTANCE_LABELS[-1])
    return df.withColumn("distance_bucket", label)


def cause_totals(df: DataFrame, cols: Sequence[str] = DELAY_CAUSES, delay: str = "arr_delay", minutes: int = 15) -> DataFrame:
    """Delay minutes by cause over the delayed trips."""
    return df.filter(F.col(delay) >= minutes).agg(*[F.sum(c).alias(c) for c in cols])


def top_rows(df: DataFrame, by: str, cols: Sequence[str], n: int = 20) -> DataFrame:
    """The ``n`` rows with the largest ``by``; the remaining columns break ties."""
    return df.select(*cols).orderBy(F.desc(by), *[c for c in cols if c != by]).limit(n)
