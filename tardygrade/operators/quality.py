"""Data-quality profiles: counts of nulls, duplicates, values and rule violations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import PROFILE_PERCENTILES
from ..session import materialize
from ..sources.tables import rows_frame
from .quantiles import exact_quantiles, present
from .silver import clean_midnight, decode_hhmm


def per_column(df: DataFrame, cols: Sequence[str], stats: dict[str, Callable[[str], Column]]) -> DataFrame:
    """One row per column with the given statistics, from a single global aggregate."""
    flat = [make(c).alias(f"{i}_{name}") for i, c in enumerate(cols) for name, make in stats.items()]
    rows = [
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{i}_{name}").alias(name) for name in stats])
        for i, c in enumerate(cols)
    ]
    return df.agg(*flat).select(F.inline(F.array(*rows)))


def per_numeric_column(df: DataFrame, cols: Sequence[str], stats: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per numeric column with the given statistics of its values, NaN read as null.

    For many columns: rows are turned into (column, value) pairs, which map-side
    aggregation reduces to one row per column and task at once. The aggregate then
    has a few expressions instead of a few per column, which the JVM compiles well.
    """
    names = F.array(*[F.lit(c) for c in cols])
    pairs = df.select(F.posexplode(F.array(*[present(c) for c in cols])).alias("_place", "_value"))
    table = pairs.groupBy("_place").agg(*[make(F.col("_value")).alias(name) for name, make in stats.items()])
    return table.select(names[F.col("_place")].alias("column_name"), *stats)


def null_counts(df: DataFrame) -> DataFrame:
    """One row with the number of nulls in every column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Number of distinct rows that occur more than once.

    Equal rows have equal hashes, so only rows whose hash repeats can be copies.
    The first pass shuffles hashes with map-side counts, not rows; whole rows are
    compared only among the candidates, which settles hash collisions. ``df`` is read
    twice, so it should be a stored table.
    """
    keyed = df.withColumn("_row_hash", F.xxhash64(*df.columns))
    repeated = keyed.groupBy("_row_hash").count().filter("count > 1").select("_row_hash")
    # Written, so that the whole rows are not shuffled where few hashes repeat.
    repeated = materialize(repeated, "repeated_hashes")
    copies = keyed.join(repeated, "_row_hash", "left_semi").groupBy(*df.columns).count().filter("count > 1")
    return copies.agg(F.count("*").alias("duplicate_groups"))


def summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of numeric columns, one row each.

    ``df`` is read twice, once for the quartiles, so it should be a stored table.
    """
    quartiles = exact_quantiles(df, cols, (0.25, 0.50, 0.75))
    names = ("p25", "p50", "p75")
    stats = {
        "n": F.count,
        "mean": F.avg,
        "stddev": F.stddev_samp,
        "min": F.min,
        "max": F.max,
    }
    table = per_numeric_column(df, cols, stats)
    for i, name in enumerate(names):
        table = table.withColumn(name, _pick("column_name", {c: q[i] for c, q in quartiles.items()}))
    return table.select("column_name", "n", "mean", "stddev", "min", *names, "max")


def _pick(key: str, values: dict[str, float | None]) -> Column:
    """The number that belongs to the value of a key column."""
    found = F.lit(None).cast("double")
    for name, value in values.items():
        found = F.when(F.col(key) == name, F.lit(value).cast("double")).otherwise(found)
    return found


def value_counts(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, ties in key order."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)
    return counts if limit is None else counts.limit(limit)


def missing_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows and missing values of some columns per group."""
    missing = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in cols]
    return df.groupBy(*keys).agg(F.count("*").alias("flights"), *missing).orderBy(*keys)


def pct_of_total(df: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Rows per group and their percentage of all rows, or of the rows of the ``within`` columns.

    The total is a window over the aggregate, which has one row per label.
    """
    total = F.sum("flights").over(Window.partitionBy(*within))
    counts = df.groupBy(*within, *keys).agg(F.count("*").alias("flights"))
    return counts.withColumn("percentage", F.round(F.col("flights") / total * 100, 2))


# Rules ----------------------------------------------------------------------


def _bad_clock(time: str) -> Column:
    return (F.col(time) < 0) | (F.col(time) > 2359) | (F.col("scheduled_dep_minute") > 59)


def _bad_distance() -> Column:
    return F.col("distance") <= 0


def _bad_flags() -> Column:
    """A flag other than 0 or 1; a missing flag is not reported."""
    return ~F.col("cancelled").isin(0, 1) | ~F.col("diverted").isin(0, 1)


def _conflicting_flags() -> Column:
    return (F.col("cancelled") == 1) & (F.col("diverted") == 1)


def invalid_time(df: DataFrame, cleaned: bool = False) -> DataFrame:
    """Rows whose departure time is no clock time, before or after 2400 is cleaned."""
    if cleaned:
        return clean_midnight(df).filter(_bad_clock("crs_dep_time_clean"))
    return decode_hhmm(df).filter(_bad_clock("crs_dep_time"))


def midnight_audit(df: DataFrame) -> DataFrame:
    """Rows with departure time 2400 and what they are cleaned to."""
    cols = ["crs_dep_time", "crs_dep_time_clean", "scheduled_dep_hour", "scheduled_dep_minute"]
    return clean_midnight(df).filter(F.col("crs_dep_time") == 2400).select(*cols)


def bad_distance(df: DataFrame) -> DataFrame:
    return df.filter(_bad_distance())


def bad_flags(df: DataFrame) -> DataFrame:
    return df.filter(_bad_flags())


def conflicting_flags(df: DataFrame) -> DataFrame:
    return df.filter(_conflicting_flags())


def violations(df: DataFrame) -> DataFrame:
    """Number of rows that break each rule, in one pass."""
    raw = decode_hhmm(df).withColumn("_bad_raw", _bad_clock("crs_dep_time"))
    checked = clean_midnight(raw)
    rules = {
        "invalid_time_raw": F.col("_bad_raw"),
        "invalid_time_clean": _bad_clock("crs_dep_time_clean"),
        "bad_distance": _bad_distance(),
        "bad_flags": _bad_flags(),
        "conflicting_flags": _conflicting_flags(),
    }
    return per_column(checked, list(rules), {"n_rows": lambda rule: F.count_if(rules[rule])}).withColumnRenamed(
        "column_name", "rule"
    )


# Feature and score profiles -------------------------------------------------


def value_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minimum and maximum per column."""
    return per_column(df, cols, {"min": lambda c: F.min(c), "max": lambda c: F.max(c)})


def value_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows and percentage per value of several columns, (field, label, flights, percentage), in one pass."""
    cells = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("label")) for c in cols]
    return pct_of_total(df.select(F.inline(F.array(*cells))), ["label"], ["field"])


def unreliable_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All rows, and rows without a value, per column."""
    return per_column(df, cols, {"total": lambda c: F.count("*"), "unreliable": lambda c: F.count_if(F.col(c).isNull())})


def feature_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing (null or NaN) and infinite values per column."""
    stats = {
        "n_missing": lambda x: F.count_if(x.isNull()),
        "n_infinite": lambda x: F.count_if(F.abs(x) == float("inf")),
    }
    return per_numeric_column(df, cols, stats)


def probability_profile(df: DataFrame, col: str, percentiles: Sequence[float] = PROFILE_PERCENTILES) -> DataFrame:
    """Count, mean, sample deviation, minimum, percentiles and maximum of a score as (statistic, value).

    ``df`` is read twice, once for the percentiles, so it should be a stored table.
    """
    row = df.agg(
        F.count(present(col)).cast("double"), F.avg(present(col)), F.stddev_samp(present(col)),
        F.min(present(col)), F.max(present(col)),
    ).first()
    found = exact_quantiles(df, [col], percentiles)[col]
    rows = list(zip(("count", "mean", "std", "min"), row[:4]))
    rows += [(f"{p:.0%}", q) for p, q in zip(percentiles, found)] + [("max", row[4])]
    return rows_frame(df.sparkSession, rows, "statistic string, value double")


def preview(df: DataFrame, cols: Sequence[str], order: Sequence[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows of some columns; all of them break ties, so the rows are always the same."""
    return df.select(*cols).orderBy(*order, *[c for c in cols if c not in order]).limit(n)
