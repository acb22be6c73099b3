"""Bounded samples of labelled texts for fitting classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_counts(labels: DataFrame, label: str) -> dict[int, int]:
    """Labelled rows of each class."""
    return {r[0]: r[1] for r in labels.filter(F.col(label).isin(0, 1)).groupBy(label).count().collect()}


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    allowed: Column,
    rows: dict[int, int],
    seed: int = 0,
    text: Sequence[str] = ("text",),
) -> DataFrame:
    """(doc_id, label, text) of at most ``rows[label]`` labelled documents of each class.

    ``allowed`` is a condition on ``doc_id``; rows that fail it, or whose doc_id or label is
    null, are not seen. Rows are chosen by a hash of their doc_id, so the choice depends
    neither on the layout nor on the order of the input. A document labelled twice counts
    with its larger label. The chosen ids are at most the bound, hence broadcast. Of several
    rows with one id the one whose text has the least hash is taken, so the bound holds for
    rows too; copies of one id are reduced before the shuffle.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    order = [F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id")]
    chosen = None
    for value, bound in sorted(rows.items()):
        part = known.filter(F.col("label") == value).orderBy(*order).limit(bound)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", F.coalesce(*text, F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")
    one = F.min_by("text", F.struct(F.xxhash64("text").alias("hash"), F.col("text").alias("text")))
    return found.groupBy("doc_id", "label").agg(one.alias("text"))
