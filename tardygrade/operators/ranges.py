"""Running totals in an order that no single task sees as a whole."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_totals(
    df: DataFrame, order: Sequence[Column], measures: Sequence[str], groups: Sequence[str] = (), label: str = "ranges"
) -> DataFrame:
    """Adds ``cum_<measure>``, the total of the rows up to and with each row, per group.

    Rows are dealt out in ranges of the groups and the order, which Spark cuts by the data, and
    written with the number of their range. Totals of the ranges, a row for each range and group,
    give what comes before a range; running totals are needed within ranges only. So a group
    may hold any share of the rows, and values may lie anywhere. Rows that compare equal in
    ``order`` are in one range, so they should be counted together before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *groups, *order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, label)

    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*groups, "_range").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    before = [F.coalesce(F.sum(f"_{m}").over(earlier), F.lit(0)).alias(f"_before_{m}") for m in measures]
    keys = [*groups, "_range"]
    before = totals.select(*[F.col(k).alias(f"_own_{k}") for k in keys], *before)

    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = dealt.withColumns({f"_within_{m}": F.sum(m).over(upto) for m in measures})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in keys])
    sums = [(F.col(f"_within_{m}") + F.col(f"_before_{m}")).alias(f"cum_{m}") for m in measures]
    return within.join(before, same).select(*df.columns, *sums)
