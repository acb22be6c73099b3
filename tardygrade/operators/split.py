"""Split by time, sampling, and frequency encoding learnt on the training part."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import CATEGORICAL
from ..functions import first_match
from ..session import materialize
from .ranges import running_totals

PARTS = ("train", "validation", "test")
# Groups of digests by their first 16 bits.
GROUPS = 1 << 16


def temporal_split(df: DataFrame, train_end: Date, validation_end: Date, date: str = "fl_date") -> DataFrame:
    """Adds ``part``: train before the first date, validation before the second, test from there on."""
    day = F.col(date)
    rules = [(day < F.lit(train_end), PARTS[0]), (day < F.lit(validation_end), PARTS[1]), (day.isNotNull(), PARTS[2])]
    return df.withColumn("part", first_match(rules))


def part_of(df: DataFrame, name: str) -> DataFrame:
    """The rows of one part, without the ``part`` column."""
    return df.filter(F.col("part") == name).drop("part")


def bernoulli(df: DataFrame, n: int | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """Each row with the same chance: a given fraction, or the one that yields about ``n`` rows.

    The rows drawn depend on how the data is partitioned; ``hash_sample`` does not.
    """
    if fraction is None:
        fraction = n / max(df.count(), 1)
    return df.sample(withReplacement=False, fraction=min(fraction, 1.0), seed=seed)


def _digest(df: DataFrame, keys: Sequence[str] | None) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys or df.columns]))


def _group(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def sample_reach(rows: int, n: int) -> int:
    """So many groups of digests that about twice ``n`` of ``rows`` rows, and a few more, are in them."""
    return min(GROUPS, 2 * (n + 100) * GROUPS // max(rows, 1) + 1)


def in_reach(df: DataFrame, groups: int, keys: Sequence[str] | None = None) -> Column:
    """Whether a row is in the first ``groups`` groups of digests.

    ``exact_sample`` orders rows by their digests, so if these groups have as many rows as it takes, it takes
    the same ones from them as from all rows.
    """
    return _group(_digest(df, keys)) < groups


def exact_sample(df: DataFrame, n: int, keys: Sequence[str] | None = None) -> DataFrame:
    """Exactly ``n`` rows, or all if there are fewer: those with the smallest MD5 of their keys.

    The rows do not depend on how the data is partitioned. ``keys`` are all columns by default;
    of rows with equal keys the first by their columns are taken. One pass counts the first 16
    bits of the digests, in at most 65,536 groups, and tells up to which group all rows belong
    to the sample. Only the rows of the one group in which it ends are ordered, in ranges, with
    equal rows as one. The sample itself is a filter and stays as spread as its input.
    """
    digest = _digest(df, keys)
    group = _group(digest)
    counts = df.groupBy(group.alias("g")).agg(F.count("*").alias("n"))
    # A window over at most 65,536 rows, of which one is collected.
    upto = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    through = counts.withColumn("through", F.sum("n").over(upto))
    last = through.filter(F.col("through") >= n).orderBy("g").limit(1).collect()
    if not last:
        return df
    end, rest = last[0]["g"], n - (last[0]["through"] - last[0]["n"])
    edge = df.filter(group == end).groupBy(*df.columns).agg(F.count("*").alias("_n"))
    order = [F.asc("_digest"), *[F.asc(c) for c in df.columns]]
    edge = running_totals(edge.withColumn("_digest", digest), order, ["_n"], label="sample_edge")
    copies = F.least(F.col("_n"), F.lit(rest) - (F.col("cum__n") - F.col("_n")))
    edge = edge.withColumn("_copies", copies).filter("_copies > 0")
    edge = edge.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return df.filter(group < end).unionByName(edge.select(*df.columns))


def hash_sample(df: DataFrame, keys: Sequence[str], permille: int) -> DataFrame:
    """About ``permille`` of 1000 rows, chosen by the MD5 of their keys; the same rows on every run."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1000
    return df.filter(bucket < permille)


def fit_frequencies(train: DataFrame, cols: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Rows per value of each column as (column_name, value, frequency), written to the shared folder.

    The rows are counted once per combination of values; the counts per column add
    these up. The written table tells the optimizer its size, so that the joins
    broadcast it when it is small and shuffle when it is not.
    """
    return _added_up(train.groupBy(*cols).agg(F.count("*").alias("n")), cols)


def _added_up(together: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Frequencies from the rows ``n`` of each combination of values; those of combinations without rows are left out."""
    together = together.filter("n > 0")
    tables = [
        together.groupBy(F.col(c).cast("string").alias("value"))
        .agg(F.sum("n").alias("frequency"))
        .select(F.lit(c).alias("column_name"), "value", "frequency")
        for c in cols
    ]
    return materialize(reduce(DataFrame.unionByName, tables), "frequencies")


def apply_frequencies(df: DataFrame, frequencies: DataFrame, cols: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Adds ``<col>_frequency``; a value that training never saw has none.

    The frequencies are joined with the distinct combinations of values, and the wide rows with the
    result once. Its rows are unique, so a hot combination can only be on the wide side, where
    adaptive execution splits it.
    """
    return _with_frequencies(df, df.select(*cols).distinct(), frequencies, cols)


def _with_frequencies(df: DataFrame, found: DataFrame, frequencies: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``apply_frequencies`` with the distinct combinations of values given."""
    for c in cols:
        table = frequencies.filter(F.col("column_name") == c).select(
            F.col("value").alias("_value"), F.col("frequency").alias(f"{c}_frequency")
        )
        found = found.join(table, F.col(c).cast("string") == F.col("_value"), "left").drop("_value")
    # Written, so that the wide rows are not shuffled where the combinations turn out to be few.
    found = materialize(found.withColumnsRenamed({c: f"_own_{c}" for c in cols}), "combinations")
    same = [F.col(c).eqNullSafe(F.col(f"_own_{c}")) for c in cols]
    return df.join(found, same, "left").drop(*[f"_own_{c}" for c in cols])


def freq_encode(df: DataFrame, cols: Sequence[str] = CATEGORICAL, part: str = "train") -> DataFrame:
    """Frequency columns for all parts of a split table, learnt on one of them.

    Combinations of values are counted in one pass, which gives both those of that part and those of all.
    """
    together = df.groupBy(*cols).agg(F.count_if(F.col("part") == part).alias("n"))
    together = materialize(together, "counted_combinations")
    return _with_frequencies(df, together.select(*cols), _added_up(together, cols), cols)
