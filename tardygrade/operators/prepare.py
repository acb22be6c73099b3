"""Preparation of model inputs: imputation, scaling and class weights, learnt on the training part."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import per_numeric_column
from .quantiles import exact_quantiles, present


def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact median per column; a column without any value gets 0, which makes it constant."""
    found = exact_quantiles(df, cols, [0.5])
    return {c: 0.0 if q[0] is None else float(q[0]) for c, q in found.items()}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Columns as doubles, with nulls and NaN replaced by the medians."""
    return df.withColumns({c: F.coalesce(present(c), F.lit(m)) for c, m in medians.items()})


def fit_scale(
    df: DataFrame, cols: Sequence[str], medians: dict[str, float] | None = None
) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column has deviation 1.

    With ``medians`` the figures are those after imputation, put together from the
    moments of the values that are there, so the table need not be imputed for it.
    """
    stats = {
        "rows": lambda x: F.count("*"),
        "n": F.count,
        "mean": F.avg,
        "var": F.var_pop,
    }
    result = {c: (0.0, 1.0) for c in cols}
    for r in per_numeric_column(df, cols, stats).collect():
        n, mean, var = r["n"], r["mean"] or 0.0, r["var"] or 0.0
        if medians is not None and r["rows"] > n:
            gaps, filler = r["rows"] - n, medians[r["column_name"]]
            overall = (n * mean + gaps * filler) / r["rows"]
            var = (n * (var + (mean - overall) ** 2) + gaps * (filler - overall) ** 2) / r["rows"]
            mean = overall
        result[r["column_name"]] = (mean, math.sqrt(var) or 1.0)
    return result


def scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns shifted to mean 0 and scaled to deviation 1."""
    return df.withColumns({c: (present(c) - mean) / std for c, (mean, std) in stats.items()})


def class_weights(df: DataFrame, label: str = "is_delayed") -> DataFrame:
    """Balanced weight n / (classes * n_class) per label, one row each."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    balanced = totals.select(F.col("rows") / F.col("classes")).scalar()
    return counts.select(label, "n", (balanced / F.col("n")).alias("weight"))


def pos_weight(df: DataFrame, label: str = "is_delayed") -> DataFrame:
    """Negatives, positives and their ratio; null without positives."""
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives")
    )
    return counts.withColumn("scale_pos_weight", F.try_divide("negatives", "positives"))
