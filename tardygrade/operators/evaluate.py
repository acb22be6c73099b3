"""Classifier metrics as aggregates over scored rows. Rows without a label are left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import zero_safe
from .ranges import running_totals


def outcomes(label: str, pred: Column) -> dict[str, Column]:
    """Counts of the four outcomes for a 0/1 prediction column."""
    y = F.col(label)
    return {
        "tp": F.count_if((y == 1) & (pred == 1)),
        "fp": F.count_if((y == 0) & (pred == 1)),
        "tn": F.count_if((y == 0) & (pred == 0)),
        "fn": F.count_if((y == 1) & (pred == 0)),
    }


def _quality(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1, each 0 where its denominator is."""
    return {
        "precision": zero_safe(tp, tp + fp),
        "recall": zero_safe(tp, tp + fn),
        "f1": zero_safe(2 * tp, 2 * tp + fp + fn),
    }


def metrics_of(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall and F1 from the four counts."""
    return {"accuracy": zero_safe(tp + tn, tp + fp + tn + fn), **_quality(tp, fp, fn)}


def binary_metrics(df: DataFrame, label: str = "is_delayed", pred: str = "predicted_delay") -> DataFrame:
    """Accuracy, precision, recall and F1 of a 0/1 prediction, in one row."""
    counts = df.agg(*[c.alias(name) for name, c in outcomes(label, F.col(pred)).items()])
    metrics = metrics_of(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return counts.select(*[c.alias(name) for name, c in metrics.items()])


def baseline_metrics(df: DataFrame, label: str = "is_delayed") -> DataFrame:
    """The metrics of predicting 0 for every row."""
    return binary_metrics(df.select(label, F.lit(0).alias("_zero")), label, "_zero")


def confusion(df: DataFrame, label: str = "is_delayed", pred: str = "predicted_delay") -> DataFrame:
    """The confusion matrix as four rows, zero counts included."""
    cells = [("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)]
    rows = [
        F.struct(F.lit(y).alias("actual"), F.lit(p).alias("predicted"), F.col(name).alias("n")) for name, y, p in cells
    ]
    counts = df.agg(*[c.alias(name) for name, c in outcomes(label, F.col(pred)).items()])
    return counts.select(F.inline(F.array(*rows)))


def threshold_sweep(
    df: DataFrame, thresholds: Sequence[float], label: str = "is_delayed", score: str = "delay_probability"
) -> DataFrame:
    """Precision, recall and F1 per threshold, all from one pass without multiplying rows."""
    measures, rows = [], []
    for i, t in enumerate(thresholds):
        counts = outcomes(label, (F.col(score) >= t).cast("int"))
        measures += [counts[name].alias(f"{name}{i}") for name in ("tp", "fp", "fn")]
        quality = _quality(*[F.col(f"{name}{i}") for name in ("tp", "fp", "fn")])
        rows.append(F.struct(F.lit(float(t)).alias("threshold"), *[c.alias(name) for name, c in quality.items()]))
    return df.agg(*measures).select(F.inline(F.array(*rows)))


def classification_report(df: DataFrame, label: str = "is_delayed", pred: str = "predicted_delay") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, plain and weighted averages."""
    counts = df.agg(*[c.alias(name) for name, c in outcomes(label, F.col(pred)).items()])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    zero, one = _quality(tn, fn, fp), _quality(tp, fp, fn)
    support = {"0": tn + fp, "1": tp + fn}
    total = support["0"] + support["1"]

    def row(name: str, values: dict[str, Column], n: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), *[values[m].alias(m) for m in zero], n.alias("support"))

    def share(n: Column) -> Column:
        return zero_safe(n, total)

    accuracy = zero_safe(tp + tn, total)
    rows = [
        row("0", zero, support["0"]),
        row("1", one, support["1"]),
        row("accuracy", {m: accuracy for m in zero}, total),
        row("macro avg", {m: (zero[m] + one[m]) / 2 for m in zero}, total),
        row("weighted avg", {m: zero[m] * share(support["0"]) + one[m] * share(support["1"]) for m in zero}, total),
    ]
    return counts.select(F.inline(F.array(*rows)))


# Ranking metrics ------------------------------------------------------------


def ranked_scores(
    df: DataFrame, label: str = "is_delayed", score: str = "delay_probability", **sums: Column
) -> DataFrame:
    """Positives and negatives per distinct score, and how many rank at or above it.

    A single window over all scores would put every distinct score into one task. So the
    distinct scores are dealt out in ranges that the data cut, and totals are carried from
    range to range. Scores may be probabilities, margins or anything else that has an order.
    Rows without a label or a score have no rank; they only add to ``sums``, further
    aggregates per score.
    """
    y, s = F.col(label), F.col(score)
    if not sums:
        df = df.filter(y.isNotNull() & s.isNotNull())
    counts = [F.count_if((y == value) & s.isNotNull()).alias(name) for name, value in (("pos", 1), ("neg", 0))]
    groups = df.groupBy(s.alias("score")).agg(*counts, *[c.alias(name) for name, c in sums.items()])
    return running_totals(groups, [F.desc("score")], ["pos", "neg"], label="scores")


def ranking() -> dict[str, Column]:
    """The figures of a table of ranked scores, as aggregates."""
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2))
    gain = F.sum(F.try_divide(F.col("pos") * F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")))
    return {
        "roc_auc": F.try_divide(area, F.sum("pos").cast("double") * F.sum("neg")),
        "average_precision": F.try_divide(gain, F.sum("pos")),
    }


def roc_auc(df: DataFrame, label: str = "is_delayed", score: str = "delay_probability") -> DataFrame:
    """Area under the ROC curve; tied scores count half. Null with a single class."""
    return ranked_scores(df, label, score).agg(ranking()["roc_auc"].alias("roc_auc"))


def average_precision(df: DataFrame, label: str = "is_delayed", score: str = "delay_probability") -> DataFrame:
    """Mean of the precision at each distinct score, weighted by the gain in recall; no interpolation."""
    return ranked_scores(df, label, score).agg(ranking()["average_precision"].alias("average_precision"))


def ranking_metrics(df: DataFrame, label: str = "is_delayed", score: str = "delay_probability") -> DataFrame:
    """ROC-AUC and average precision from one ranking."""
    return ranked_scores(df, label, score).agg(*[c.alias(name) for name, c in ranking().items()])
