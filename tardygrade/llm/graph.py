"""Connected components of a graph that is too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns ``a`` and ``b``).

    Alternates two star operations until nothing changes; after that every node points
    to the smallest node of its component. Each step is one aggregation and one join on
    narrow rows, never a list of neighbours, so a node may have any number of edges. The
    number of steps grows with the logarithm of the longest path. Each step is a written
    table, so a lost executor costs one step.
    """
    child, parent = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    current = materialize(edges.filter("a != b").select(child, parent).distinct(), "edges")
    state = _state(current)
    while state[0]:
        current = materialize(_small_star(_large_star(current)), "edges")
        previous, state = state, _state(current)
        if state == previous:
            break
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number and fingerprint of the edges."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are moved to its smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node are moved to the smallest one, and the node too."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
