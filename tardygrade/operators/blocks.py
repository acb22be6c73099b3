"""History of the trips of some days, put together at a time.

What other days add to it comes in as *sums*, of everything before the days of a group, one row
for each key and value of a context's second column that the group has, and as *points*, the trips
of the days before in which a frame may end. What lies between is counted here, by binary search.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Functions of this module travel to the tasks themselves, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 86_400
# Rows that are counted at a time.
FLUSH = 1 << 20
# Rows that go back to Spark at a time, which holds them outside its heap.
BATCH = 1 << 14
COUNTS = ("n", "known", "late")
POINT = 0


@dataclass(frozen=True)
class Frame:
    """Everything before ``moment - back``: the sums before a day, and what lies at hand from there on."""

    back: int
    lag: int  # how many days before its group the sums end


@dataclass(frozen=True)
class DayPart:
    """History of earlier days of a key: all of them, and the last ``days``."""

    kind: int
    key: str
    days: int
    names: tuple[str, ...]


@dataclass(frozen=True)
class ContextPart:
    kind: int
    key: str
    by: str
    frames: tuple[Frame, ...]  # the expanding one, and the one that is taken off for a trailing span
    names: tuple[str, ...]
    points: bool  # whether a frame may end before the days of a group


@dataclass(frozen=True)
class Layout:
    """How trips lie, and what their columns are called."""

    date: str
    label: str | None
    times: tuple[str, ...]
    width: int  # days of a group
    lead: int  # earliest day before a group in which a frame may end


def sums(lag: int) -> list[str]:
    """The columns that hold the counts of everything before a day ``lag`` days earlier."""
    return [f"_{c}_{lag}" for c in COUNTS]


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _codes(*sides: pa.Array) -> list[np.ndarray]:
    """Small numbers that are equal where values are; missing values equal each other."""
    together = pa.concat_arrays([s.cast(sides[0].type) for s in sides]).dictionary_encode(null_encoding="encode")
    return np.split(together.indices.to_numpy().astype(np.int64), np.cumsum([len(s) for s in sides])[:-1])


def _joint(span: int, *pairs: Sequence[np.ndarray]) -> list[np.ndarray]:
    """One number per row for two columns of numbers, on both sides, that leaves room for ``span`` times as many."""
    (a, b), (c, d) = pairs
    radix = max(c.max(initial=0), d.max(initial=0)) + 1
    mine, theirs = a * radix + c, b * radix + d
    if (int(max(a.max(initial=0), b.max(initial=0))) + 1) * int(radix) * span >= 1 << 62:
        found = np.unique(np.concatenate([mine, theirs]), return_inverse=True)[1].astype(np.int64)
        mine, theirs = np.split(found, [len(mine)])
    return [mine, theirs]


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers and where they are known."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ~np.asarray(column.is_null())


@dataclass
class _Rows:
    """Trips with their day and, where they have one, moment, and how many trips, labels and late trips they stand for."""

    day: np.ndarray
    dated: np.ndarray
    at: np.ndarray
    timed: np.ndarray
    counts: list[np.ndarray]

    @staticmethod
    def of(table: pa.Table, layout: Layout) -> _Rows:
        day, dated = _whole(_column(table, layout.date).cast(pa.int32()))
        at, timed = day * BLOCK, dated if layout.times else np.zeros(len(day), bool)
        for name, seconds in zip(layout.times, (3_600, 60)):
            value, has = _whole(_column(table, name))
            at, timed = at + value * seconds, timed & has
        if layout.label is None:
            counts = [_whole(_column(table, f"_{c}"))[0] for c in COUNTS]
        else:
            late, labelled = _whole(_column(table, layout.label))
            counts = [np.ones(len(at), np.int64), labelled.astype(np.int64), late]
        return _Rows(day, dated, at, timed, counts)


def _batches(table: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with all columns of a schema; those that are not given are missing."""
    n = len(table["_kind"])
    columns = [table[f.name].cast(f.type) if f.name in table else pa.nulls(n, f.type) for f in schema]
    yield from pa.table(columns, schema=schema).combine_chunks().to_batches()


def _flushed(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[pa.Table]:
    """Some columns of the rows that lie in a partition, a bounded number at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch.select(list(columns)))
        rows += batch.num_rows
        if rows >= FLUSH:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _typed(table: pa.Table, names: Sequence[str], keys: Sequence[str]) -> pa.Schema:
    kinds = {"_kind": pa.int32(), "_group": pa.int32()}
    kinds |= {c: table.schema.field(c).type for c in keys}
    return pa.schema([(c, kinds.get(c, pa.int64())) for c in names])


def counted(parts: Sequence[DayPart | ContextPart], columns, names, keys, layout: Layout) -> Callable:
    """Trips per group, key and day or second column, as rows with ``names``.

    A group lies in one partition, so it has few such rows; where one is cut in two, both have the same sums later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _flushed(batches, columns):
            schema, rows = _typed(table, names, keys), _Rows.of(table, layout)
            counts = dict(zip(COUNTS, map(pa.array, rows.counts)))
            for part in parts:
                by_day = isinstance(part, DayPart)
                held = [part.key] if by_day else list(dict.fromkeys([part.key, part.by]))
                order = pa.array(rows.day) if by_day else _column(table, "_group").cast(pa.int64())
                given = {c: _column(table, c) for c in ("_group", *held)} | {"_order": order} | counts
                given = pa.table(given).filter(pa.array(rows.dated if by_day else rows.timed))
                groups = given.group_by(["_group", "_order", *held], use_threads=False)
                groups = groups.aggregate([(c, "sum") for c in COUNTS])
                if groups.num_rows:
                    found = {c: groups.column(c) for c in ("_group", "_order", *held)}
                    found |= {c: groups.column(f"{c}_sum") for c in COUNTS}
                    yield from _batches(found | {"_kind": pa.array(np.full(groups.num_rows, part.kind))}, schema)

    return run


def moved(shifts: Sequence[int], held: Sequence[str], columns, names, keys, layout: Layout) -> Callable:
    """Trips for the groups that hold the days ``shifts`` later, if these are others than their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _flushed(batches, columns):
            schema, rows = _typed(table, names, keys), _Rows.of(table, layout)
            own = _whole(_column(table, "_group"))[0]
            for shift in shifts:
                group = (rows.at // BLOCK + shift) // layout.width
                there = np.flatnonzero(rows.timed & (group != own))
                if len(there):
                    found = {c: _column(table, c).take(pa.array(there)) for c in held}
                    found |= {c: pa.array(x[there]) for c, x in zip(COUNTS, rows.counts)}
                    found |= {"_group": pa.array(group[there]), "_order": pa.array(rows.at[there])}
                    yield from _batches(found | {"_kind": pa.array(np.full(len(there), POINT))}, schema)

    return run


def _rates(sums: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Trips, and late trips per trip: null without trips or without any known label."""
    n, known, late = sums
    return pa.array(n), pa.array(late / np.maximum(n, 1), mask=(known <= 0) | (n <= 0))


def _in_order(trips: pa.Table, key: str, layout: Layout) -> pa.Table:
    """Trips by day, key and moment: neighbours have the same or close sums, which take little room when they are stored."""
    rows = _Rows.of(trips, layout)
    return trips.take(pa.array(np.lexsort((rows.at, _codes(_column(trips, key))[0], rows.day))))


def attached(parts: Sequence[DayPart | ContextPart], kept: Sequence[str], layout: Layout) -> Callable:
    """The trips of a group with their history, from the trips and from the sums and points for it."""

    def run(key: tuple, trips: pa.Table, info: pa.Table) -> pa.Table:
        trips = _in_order(trips, parts[0].key, layout)
        own = _Rows.of(trips, layout)
        start = key[0].as_py() * layout.width * BLOCK
        kind = _whole(_column(info, "_kind"))[0]
        codes = {}
        for part in parts:
            for name in (part.key, *([part.by] if isinstance(part, ContextPart) else [])):
                if name not in codes:
                    codes[name] = _codes(_column(trips, name), _column(info, name))
        found = {name: trips.column(name) for name in kept}
        for part in parts:
            put = _days if isinstance(part, DayPart) else _context
            found |= put(part, own, trips, info, kind, codes, start, layout)
        found = pa.table(found).combine_chunks()
        return pa.Table.from_batches(found.to_batches(BATCH), found.schema)

    return run


def _place(mine: np.ndarray, theirs: np.ndarray, info: pa.Table, rows: np.ndarray) -> Callable[[int], list[np.ndarray]]:
    """The sums of a lag for each trip, from the row of its key; 0 where there is none."""
    if not len(rows):
        return lambda lag: [np.zeros(len(mine), np.int64) for _ in COUNTS]
    order = np.argsort(theirs)
    theirs = theirs[order]
    at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
    hit, at = theirs[at] == mine, rows[order[at]]
    return lambda lag: [np.where(hit, _whole(_column(info, name))[0][at], 0) for name in sums(lag)]


def _days(part: DayPart, own: _Rows, trips: pa.Table, info: pa.Table, kind, codes, start, layout: Layout) -> dict:
    """Day history: counts are null where there is no earlier day, or no key; trips without a date have none."""
    rows = np.flatnonzero(kind == part.kind)
    mine, theirs = codes[part.key]
    day = _whole(_column(info, "_order"))[0][rows]
    first = min(day.min(initial=0), own.day.min(initial=0))
    mine, theirs = _joint(1, (mine, theirs[rows]), (own.day - first, day - first))
    before = _place(mine, theirs, info, rows)
    whole = before(0)
    has_key = own.dated & ~np.asarray(_column(trips, part.key).is_null())
    columns = []
    for n, known, late in (whole, [a - b for a, b in zip(whole, before(part.days))]):
        columns.append(pa.array(n, mask=~has_key | (n <= 0)))
        columns.append(pa.array(late / np.maximum(n, 1), mask=~has_key | (known <= 0) | (n <= 0)))
    return dict(zip(part.names, columns))


def _context(part: ContextPart, own: _Rows, trips: pa.Table, info: pa.Table, kind, codes, start, layout: Layout) -> dict:
    """The columns of one context; trips without a moment have an empty history."""
    span = (layout.width + layout.lead + 1) * BLOCK
    origin = start - layout.lead * BLOCK
    group, other = _joint(span, codes[part.key], codes[part.by])
    rows = np.flatnonzero(kind == part.kind)
    before = _place(group, other[rows], info, rows)

    here = np.flatnonzero(own.timed)
    place, at, counts = group[here], own.at[here] - origin, [c[here] for c in own.counts]
    asked, moment = place, at
    if part.points:
        points = np.flatnonzero(kind == POINT)
        place = np.concatenate([place, other[points]])
        at = np.concatenate([at, _whole(_column(info, "_order"))[0][points] - origin])
        counts = [np.concatenate([c, _whole(_column(info, s))[0][points]]) for c, s in zip(counts, sums(0))]
    line = place * span + at
    order = np.argsort(line)
    line = line[order]
    upto = [np.append(0, np.cumsum(c[order])) for c in counts]

    totals = []
    for frame in part.frames:
        low = np.searchsorted(line, asked * span + (start - frame.lag * BLOCK - origin))
        high = np.searchsorted(line, asked * span + moment - frame.back)
        total = [np.zeros(len(group), np.int64) for _ in COUNTS]
        for out, base, u in zip(total, before(frame.lag), upto):
            out[here] = base[here] + u[high] - u[low]
        totals.append(total)
    if len(totals) > 1:
        totals[1] = [a - b for a, b in zip(*totals)]
    return dict(zip(part.names, [column for total in totals for column in _rates(total)]))
