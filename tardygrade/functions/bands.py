"""Turning conditions and numeric ranges into labels."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[Column, Any]], default: Any = None) -> Column:
    """Value of the first rule whose condition is true; a null condition is not true."""
    (condition, value), *rest = rules
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def bands(
    value: Column,
    edges: Sequence[float],
    labels: Sequence[str],
    *,
    closed: str = "left",
    null_label: str | None = None,
) -> Column:
    """Label of the range that ``value`` falls in; there is one label more than edges.

    ``closed="left"`` puts an edge into the range above it, ``"right"`` into the one below.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("need exactly one label more than edges")
    below = [(value < e) if closed == "left" else (value <= e) for e in edges]
    rules = [(value.isNull(), F.lit(null_label))] + list(zip(below, labels))
    return first_match(rules, labels[-1])
