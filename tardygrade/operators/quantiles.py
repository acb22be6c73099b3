"""Exact interpolated quantiles that no single task has to hold."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranges import running_totals

# Functions of this module travel to the tasks themselves, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A sketch is made of so many rows at a time, each part keeps so many points, and merged ones keep so many.
SKETCH_ROWS, PART_POINTS, POINTS = 1 << 16, 512, 1024
# Sketches are merged in each task, in groups of tasks if there are more tasks than groups, and over all.
SALTS, MERGES = 64, 3
# A point stands for the rows around it, so each step moves a rank by half a point's share at most.
RANK_ERROR = 1 / (2 * PART_POINTS) + MERGES / (2 * POINTS)


def present(col: str | Column) -> Column:
    """The column as a double, with NaN read as missing."""
    value = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


# Sketches -------------------------------------------------------------------


def _condensed(values: np.ndarray, weights: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``points`` sorted values, each with the weight of the rows around it."""
    order = np.argsort(values)
    values, weights = values[order], weights[order]
    if len(values) <= points:
        return values, weights
    upto = np.cumsum(weights)
    middles = (np.arange(points) + 0.5) * (upto[-1] / points)
    at = np.minimum(np.searchsorted(upto, middles), len(values) - 1)
    return values[at], np.full(points, upto[-1] / points)


_SKETCH = "place int, salt int, points binary, weights binary"


def _message(place: int, salt: int, values: np.ndarray, weights: np.ndarray) -> pa.Table:
    columns = [pa.array([place], pa.int32()), pa.array([salt], pa.int32()), pa.array([values.tobytes()]), pa.array([weights.tobytes()])]
    return pa.Table.from_arrays(columns, names=["place", "salt", "points", "weights"])


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The values of each column, up to ``SKETCH_ROWS`` rows at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= SKETCH_ROWS:
            yield [c.drop_null().to_numpy() for c in pa.Table.from_batches(held).columns]
            held, rows = [], 0
    if held:
        yield [c.drop_null().to_numpy() for c in pa.Table.from_batches(held).columns]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sketch of each column of a task."""
    found: dict[int, list] = {}
    for columns in _columns(batches):
        for place, values in enumerate(columns):
            if len(values):
                parts = found.setdefault(place, [])
                parts.append(_condensed(values, np.ones(len(values)), PART_POINTS))
                if len(parts) > 256:
                    # Parts of one size are put together without loss of rank until the task ends.
                    found[place] = [tuple(np.concatenate(x) for x in zip(*parts))]
    salt = TaskContext.get().partitionId() % SALTS
    for place, parts in found.items():
        yield from _message(place, salt, *_condensed(*(np.concatenate(x) for x in zip(*parts)), POINTS)).to_batches()


def _merge(group: pa.Table) -> pa.Table:
    values, weights = (np.frombuffer(b"".join(group.column(c).to_pylist())) for c in ("points", "weights"))
    return _message(group.column("place")[0].as_py(), group.column("salt")[0].as_py(), *_condensed(values, weights, POINTS))


def _sketches(doubles: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Points and running weights of each column."""
    sketches = doubles.mapInArrow(_sketch, _SKETCH)
    if doubles.rdd.getNumPartitions() > SALTS:
        sketches = sketches.groupBy("place", "salt").applyInArrow(_merge, _SKETCH)
    rows = sketches.groupBy("place").applyInArrow(_merge, _SKETCH).collect()
    return {r["place"]: (np.frombuffer(r["points"]), np.cumsum(np.frombuffer(r["weights"]))) for r in rows}


# Ranks ----------------------------------------------------------------------

Ends = dict[int, tuple[int, float, float]]  # a quantile's column and the values that enclose it


def _counted(ends: Ends):
    """Per task: rows below and at both ends of each quantile, and counts of the values between them."""

    def rows(kinds: list[tuple]) -> pa.RecordBatch:
        names = ["quantile", "value", "below", "low", "under", "high", "n"]
        types = [pa.int32(), pa.float64(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*kinds), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {q: [0, 0, 0, 0, 0] for q in ends}
        for columns in _columns(batches):
            columns = [np.sort(x) for x in columns]
            for q, (place, low, high) in ends.items():
                values = columns[place]
                at = [int(np.searchsorted(values, x, side)) for x in (low, high) for side in ("left", "right")]
                counts = at[0], at[1] - at[0], at[2], at[3] - at[2], len(values)
                sums[q] = [a + b for a, b in zip(sums[q], counts)]
                if at[1] < at[2]:
                    inner, n = np.unique(values[at[1] : at[2]], return_counts=True)
                    none = [0] * len(inner)
                    yield rows(list(zip([q] * len(inner), inner.tolist(), none, none, none, none, n.tolist())))
        yield rows([(q, None, *x) for q, x in sums.items()])

    return run


def exact_quantiles(df: DataFrame, cols: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles per column, interpolated between neighbouring values; nulls and NaN are left out.

    One pass makes a sketch of each column and merges the sketches; the error of a rank is at
    most ``RANK_ERROR`` of the rows, so two points enclose each quantile. A second pass counts,
    exactly, the values below and at both ends, which settles quantiles that fall on an end, as
    they do where many rows share a value, and the values between the ends, a small share of the
    rows. Their ranks come from running totals over ranges. Nothing else is shuffled, and the
    driver sees ``POINTS`` points per column and some numbers per quantile.
    """
    cols, probabilities = list(cols), [float(p) for p in probabilities]
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in cols}
    doubles = df.select(*[present(c).alias(f"c{k}") for k, c in enumerate(cols)])
    places = [(place, k) for place in range(len(cols)) for k in range(len(probabilities))]
    ends: Ends = {}
    for place, (points, upto) in _sketches(doubles).items():
        for q, (own, k) in enumerate(places):
            if own == place:
                rank, slack = probabilities[k] * (upto[-1] - 1), RANK_ERROR * upto[-1] + 1
                first, last = np.searchsorted(upto, [rank - slack, rank + slack])
                # Beyond the first and the last point there may be further values.
                low = points[first - 1] if first else -math.inf
                high = points[last + 1] if last + 1 < len(points) else math.inf
                ends[q] = place, float(low), float(high)
    if not ends:
        return result

    kind = "quantile int, value double, below long, low long, under long, high long, n long"
    counted = materialize(doubles.mapInArrow(_counted(ends), kind), "value_counts")
    names = ("below", "low", "under", "high", "n")
    sums = counted.filter("value IS NULL").groupBy("quantile").agg(*[F.sum(c) for c in names]).collect()
    sums = {r[0]: tuple(r)[1:] for r in sums}
    found: dict[tuple[int, int], float] = {}
    inner: dict[int, list[int]] = {}
    ranks = {}
    for q, (_, first, last) in ends.items():
        below, low, under, high, size = sums[q]
        x = probabilities[places[q][1]] * (size - 1)
        ranks[q] = x
        for rank in {math.floor(x), math.ceil(x)}:
            if not below <= rank < under + high:
                raise RuntimeError(f"the sketch of {cols[places[q][0]]} exceeds its rank error")
            if rank < below + low:
                found[q, rank] = first
            elif rank >= under:
                found[q, rank] = last
            else:
                inner.setdefault(q, []).append(rank)
    if inner:
        before = {q: sums[q][0] + sums[q][1] for q in inner}
        found |= _between(counted, {q: [r - before[q] for r in own] for q, own in inner.items()}, before)
    for q, x in ranks.items():
        low, high, weight = found[q, math.floor(x)], found[q, math.ceil(x)], x - math.floor(x)
        # Both zeros are one value.
        result[cols[places[q][0]]][places[q][1]] = (low if low == high else (1 - weight) * low + weight * high) + 0.0
    return result


def _between(counted: DataFrame, ranks: dict[int, list[int]], before: dict[int, int]) -> dict[tuple[int, int], float]:
    """Values by (quantile, rank) for ranks strictly between the ends of their quantile."""
    counts = counted.filter(F.col("value").isNotNull() & F.col("quantile").isin(list(ranks)))
    counts = counts.groupBy("quantile", (F.col("value") + F.lit(0.0)).alias("value")).agg(F.sum("n").alias("n"))
    totals = running_totals(counts, [F.col("value")], ["n"], ["quantile"], "between")
    # A few ranks for each quantile.
    wanted = F.create_map(*[x for q, own in ranks.items() for x in (F.lit(q), F.array(*[F.lit(r) for r in own]))])
    here = F.filter(wanted[F.col("quantile")], lambda r: (r < F.col("cum_n")) & (r >= F.col("cum_n") - F.col("n")))
    hits = totals.select("quantile", "value", F.explode(here).alias("rank")).collect()
    return {(q, rank + before[q]): value for q, value, rank in hits}


def grouped_medians(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """The exact median of a column per group, as ``keys`` and ``name``; groups without a value are left out.

    Values are counted per group and dealt out in ranges of group and value, so a group may hold
    any number of distinct values.
    """
    counts = df.groupBy(*keys, present(col).alias("_value")).agg(F.count("*").alias("n")).filter("_value IS NOT NULL")
    totals = running_totals(counts, [F.col("_value")], ["n"], keys, "group_values")
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_size"))
    sizes = sizes.select(*[F.col(k).alias(f"_size_{k}") for k in keys], "_size")
    same = [F.col(k).eqNullSafe(F.col(f"_size_{k}")) for k in keys]
    # The two middle rows, counted from 0, are the same one in a group of odd size.
    middle = [F.expr("(_size - 1) div 2"), F.expr("_size div 2")]
    holds = [(m < F.col("cum_n")) & (m >= F.col("cum_n") - F.col("n")) for m in middle]
    mine = totals.join(sizes, same).filter(holds[0] | holds[1])
    ends = [F.max(F.when(h, F.col("_value"))) for h in holds]
    return mine.groupBy(*keys).agg(((ends[0] + ends[1]) / 2).alias(name))
