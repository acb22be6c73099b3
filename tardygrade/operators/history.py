"""History features: how often earlier trips with the same key were late.

*Day* history of a trip looks at earlier days only: everything before its day, and the
trailing days. *Context* history looks at trips of the same key in the same hour of the
day (or on the same day of the week) that were scheduled at least ``min_lag_seconds``
earlier: all of them, and those of a trailing span.

The time line is cut into groups of days. The history of a trip is what the groups before add,
which depends on the key and the value of the second column only, and what its own group and
the days in which the trailing span begins add. Trips are shuffled once, by their group. From there
each key's trips are counted per group and second column (per day for day histories), which
are far fewer rows, summed over what is earlier and sent back to the groups; with them go the
trips of the days before a group in which a trailing span begins, as narrow rows. No step sees
all trips of a key, and a task holds the trips of one group at a time.

Missing and invalid values. A trip without a date is in no history of others, and has no
day history (null) and an empty context history (count 0). A trip without a scheduled hour
or minute has no moment: it counts for day histories, but in no context history, and its
own context history is empty. Times such as -1 or 2360 are taken as they decode: the moment
is hour * 60 + minute minutes after the start of the day. A missing key or weekday is a
group of its own in context histories.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import epoch_seconds, rate
from .blocks import COUNTS, ContextPart, DayPart, Frame, Layout, attached, counted, moved, sums

DAY_SECONDS = 86_400
TOGETHER = 1 << 18
# What a trip's histories depend on besides its key and date.
TIME = ("scheduled_dep_hour", "scheduled_dep_minute", "day_of_week")


@dataclass(frozen=True)
class Context:
    """History within one value of a second column; ``days`` adds a trailing span."""

    name: str
    by: str
    days: int | None = None
    min_lag_seconds: int = 1

    @property
    def columns(self) -> list[str]:
        return _column_names(self.name, self.days)


@dataclass(frozen=True)
class Entity:
    """One key column with its histories; ``days=None`` leaves the day history out."""

    name: str
    key: str
    days: int | None = 7
    contexts: tuple[Context, ...] = ()

    @property
    def columns(self) -> list[str]:
        return _column_names(self.name, self.days)

    @property
    def parts(self) -> list[Entity | Context]:
        """Everything that has history columns: the day history first, then the contexts."""
        return [*([self] if self.days is not None else []), *self.contexts]


def _column_names(name: str, days: int | None) -> list[str]:
    """Count and rate of the expanding history, then of the trailing one."""
    names = [f"historical_{name}_flights", f"historical_{name}_delay_rate"]
    if days is not None:
        names += [f"{name}_flights_last_{days}d", f"{name}_delay_rate_last_{days}d"]
    return names


# Keys and contexts of the first and the second feature table.
DAY_ENTITIES = (Entity("route", "route"), Entity("origin", "origin"), Entity("carrier", "op_unique_carrier"))
_BY_HOUR = ("scheduled_dep_hour", 7)
_BY_WEEKDAY = ("day_of_week", None)
ALL_ENTITIES = (
    replace(DAY_ENTITIES[0], contexts=(Context("route_hour", *_BY_HOUR), Context("route_dow", *_BY_WEEKDAY))),
    replace(DAY_ENTITIES[1], contexts=(Context("origin_hour", *_BY_HOUR), Context("origin_dow", *_BY_WEEKDAY))),
    replace(DAY_ENTITIES[2], contexts=(Context("carrier_hour", *_BY_HOUR),)),
)
CONTEXT_ENTITIES = tuple(replace(e, days=None) for e in ALL_ENTITIES)


def context_keys(df: DataFrame, entities: Sequence[Entity] = ALL_ENTITIES) -> DataFrame:
    """Adds one text key per context, for display; histories use the column pairs."""
    return df.withColumns(
        {f"{c.name}_key": F.concat_ws("_", e.key, F.col(c.by).cast("string")) for e in entities for c in e.contexts}
    )


def event_time(df: DataFrame, date: str = "fl_date") -> DataFrame:
    """Adds minutes of the day, the scheduled time as epoch seconds (UTC) and as a timestamp."""
    hour, minute = F.col("scheduled_dep_hour"), F.col("scheduled_dep_minute")
    times = {"scheduled_dep_minutes": hour * 60 + minute, "flight_timestamp": epoch_seconds(F.col(date), hour, minute)}
    return df.withColumns(times).withColumn("flight_datetime_order", F.timestamp_seconds("flight_timestamp"))


def label_counts(df: DataFrame, by: Sequence[str | Column], label: str = "is_delayed") -> DataFrame:
    """Trips, trips with a known label and late trips per group."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(label).alias("known"), F.sum(F.col(label).cast("long")).alias("late")
    )


def daily(df: DataFrame, key: str, name: str, date: str = "fl_date", label: str = "is_delayed") -> DataFrame:
    """Trips and late trips per day and key."""
    counts = label_counts(df, [date, key], label)
    return counts.select(date, key, F.col("n").alias(f"{name}_flights"), F.col("late").alias(f"{name}_delayed"))


# Windows --------------------------------------------------------------------


@dataclass(frozen=True)
class _Sums:
    """Trips, labelled trips and late trips over a frame, as columns."""

    n: Column
    known: Column
    late: Column

    @staticmethod
    def over(frame) -> _Sums:
        """Sums over a frame."""
        return _Sums(*[F.coalesce(F.sum(c).over(frame), F.lit(0)) for c in COUNTS])

    def __sub__(self, other: _Sums) -> _Sums:
        return _Sums(self.n - other.n, self.known - other.known, self.late - other.late)

    def rate(self) -> Column:
        """Late trips per trip; null without trips or without any known label."""
        return F.when(self.known > 0, rate(self.late, self.n))


def _pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    return list(zip(names[::2], names[1::2]))


# Counting and joining -------------------------------------------------------


def _grain(entity: Entity, date: str) -> list[str]:
    """The columns that the histories of an entity depend on; the date alone without contexts."""
    return [entity.key, date, *(TIME if entity.contexts else ())]


def _context_frames(context: Context) -> list[tuple[int, tuple[int, ...]]]:
    """How far before a trip its frames end, and in which earlier days that may be."""
    back = context.min_lag_seconds - 1
    days = range(-(-back // DAY_SECONDS), back // DAY_SECONDS - 1, -1)
    frames = [(back, tuple(days))]
    return frames if context.days is None else [*frames, (context.days * DAY_SECONDS, (context.days,))]


def _group_width(df: DataFrame, date: str, lead: int) -> int:
    """So many days are put together at a time that they have about ``TOGETHER`` trips; a day is never cut.

    Where a frame ends up to ``lead`` days earlier, groups are that long at least, or single days if that is too much
    for the memory of a task. There should also be some groups for each core.
    """
    row = df.agg(F.count("*").alias("n"), F.approx_count_distinct(date).alias("days")).first()
    rows, days = max(row["n"], 1), row["days"]
    spread = max(1, days // (3 * df.sparkSession.sparkContext.defaultParallelism))
    width = max(1, min(1 << 12, TOGETHER * days // rows, max(spread, lead)))
    return width if width >= lead else 1


def _parts(entities: Sequence[Entity], lead: int, width: int) -> list[DayPart | ContextPart]:
    """All histories in the order of their columns; frames start from the sums before their group, or before their day."""
    parts: list[DayPart | ContextPart] = []
    for entity in entities:
        if entity.days is not None:
            parts.append(DayPart(len(parts) + 1, entity.key, entity.days, tuple(entity.columns)))
        for context in entity.contexts:
            ends = _context_frames(context)
            frames = tuple(Frame(back, 0 if width >= lead else days[0]) for back, days in ends)
            early = any(days[0] > 0 for _, days in ends)
            parts.append(ContextPart(len(parts) + 1, entity.key, context.by, frames, tuple(context.columns), early))
    return parts


def _sums_before(counts: DataFrame, parts: Sequence[DayPart | ContextPart], keys: Sequence[str]) -> DataFrame:
    """For each row, the sums of its key's and second column's rows before it, and before some days earlier.

    Order is the day in day histories and the group in contexts, where sums some days earlier are needed
    only if groups are days.
    """
    lags = {0, *[p.days for p in parts if isinstance(p, DayPart)]}
    lags |= {f.lag for p in parts if isinstance(p, ContextPart) for f in p.frames}
    in_order = Window.partitionBy("_kind", *keys).orderBy("_order")
    columns = []
    for lag in sorted(lags):
        frame = in_order.rangeBetween(Window.unboundedPreceding, -lag - 1)
        columns += [F.sum(c).over(frame).alias(name) for c, name in zip(COUNTS, sums(lag))]
    return counts.select("_kind", "_group", "_order", *keys, *columns)


def _attach(df: DataFrame, entities: Sequence[Entity], date: str, label: str | None) -> DataFrame:
    """``attach_history`` for rows that stand for one trip, or without ``label`` for ``_n``, ``_known`` and ``_late``."""
    contexts = [(e, c) for e in entities for c in e.contexts]
    times = TIME[:2] if contexts else ()
    ends = {d for _, c in contexts for _, days in _context_frames(c) for d in days}
    lead = max(ends, default=0)
    width = _group_width(df, date, lead)
    layout = Layout(date, label, times, width, lead)
    parts = _parts(entities, lead, width)

    moment = epoch_seconds(F.col(date), *[F.col(c) for c in times]) if contexts else F.lit(None).cast("long")
    day = F.coalesce(F.floor(moment / DAY_SECONDS).cast("int"), F.unix_date(date))
    # A trip without a date has no history and adds to none, so it may be anywhere.
    anywhere = -F.lit(1 << 29) - F.pmod(F.xxhash64(*df.columns), F.lit(1 << 12)).cast("int")
    group = F.coalesce(F.floor(day / width).cast("int"), anywhere)
    laid = df.withColumn("_group", group).repartition("_group")

    keys = list(dict.fromkeys(k for p in parts for k in (p.key, *([p.by] if isinstance(p, ContextPart) else []))))
    counts = [label] if label is not None else [f"_{c}" for c in COUNTS]
    columns = list(dict.fromkeys([*keys, date, *times, *counts, "_group"]))
    names = ["_kind", "_group", "_order", *keys, *COUNTS]
    kinds = {"_kind": T.IntegerType(), "_group": T.IntegerType(), **{k: df.schema[k].dataType for k in keys}}
    made = T.StructType([T.StructField(c, kinds.get(c, T.LongType())) for c in names])
    # Both are taken from the rows as they lie, so that the shuffle is the same one and is written once.
    info = _sums_before(laid.mapInArrow(counted(parts, columns, names, keys, layout), made), parts, keys)
    early = [p for p in parts if isinstance(p, ContextPart) and p.points]
    if early:
        # Groups as long as the lead take the last days before them, single days those in which a frame ends.
        shifts = [lead] if width >= lead else sorted(ends - {0})
        held = list(dict.fromkeys(k for p in early for k in (p.key, p.by)))
        points = laid.mapInArrow(moved(shifts, held, columns, names, keys, layout), made)
        points = points.withColumnsRenamed(dict(zip(COUNTS, sums(0))))
        info = info.unionByName(points, allowMissingColumns=True)

    kept = [c for c in df.columns if label is not None or c not in counts]
    added = [c for e in entities for part in e.parts for c in part.columns]
    schema = T.StructType([df.schema[c] for c in kept])
    for k, name in enumerate(added):
        schema.add(name, T.DoubleType() if k % 2 else T.LongType())
    info = info.repartition("_group")
    return laid.groupBy("_group").cogroup(info.groupBy("_group")).applyInArrow(attached(parts, kept, layout), schema)


def attach_history(
    df: DataFrame,
    entities: Sequence[Entity],
    *,
    dense: bool = False,
    date: str = "fl_date",
    label: str = "is_delayed",
) -> DataFrame:
    """Adds the history columns of all ``entities`` to every row of ``df``.

    All columns of ``df`` are shuffled, so it should have those only that are needed later.
    ``dense=True`` is for data with many trips per minute and combination of keys:
    histories are put together for the distinct combinations, and the wide trips
    are joined with the result. ``grain_density`` measures whether that pays.
    """
    added = [c for e in entities for part in e.parts for c in part.columns]
    if not dense:
        return _attach(df, entities, date, label).select(*df.columns, *added)
    grain = list(dict.fromkeys(c for e in entities for c in _grain(e, date)))
    counted = label_counts(df, grain, label).withColumnsRenamed({c: f"_{c}" for c in ("n", "known", "late")})
    table = _attach(counted, entities, date, None)
    return _join_null_safe(df, table, grain).select(*df.columns, *added)


def grain_density(df: DataFrame, entities: Sequence[Entity] = ALL_ENTITIES, date: str = "fl_date") -> float:
    """Trips per distinct combination of keys and minute, estimated in one pass with a fixed-size sketch."""
    parts = list(dict.fromkeys(c for e in entities for c in _grain(e, date)))
    row = df.agg(F.count("*").alias("n"), F.approx_count_distinct(F.struct(*parts), 0.02).alias("groups")).first()
    return row["n"] / max(row["groups"], 1)


def history_for_key(df: DataFrame, entity: Entity, values: dict, **options) -> DataFrame:
    """Trips of one key (and hour or weekday) with their history; other keys are dropped before counting."""
    for column, value in values.items():
        df = df.filter(F.col(column) == value)
    return attach_history(df, [entity], **options)


# Times to the second --------------------------------------------------------


def attach_second_history(
    df: DataFrame,
    keys: Sequence[str],
    name: str,
    ts: str,
    *,
    days: int = 7,
    min_lag_seconds: int = 1,
    block_seconds: int = DAY_SECONDS,
    label: str = "is_delayed",
) -> DataFrame:
    """Context history for times to the second, where one key can have too many points for a task.

    The time line is cut into blocks. A sum over everything before a moment is the sum
    of the earlier blocks and of the earlier points in its block, so a window group is
    one block of one key, or the list of blocks of one key. The moments asked for need
    not be points, so each point also emits empty rows at the ends of its two frames.
    """
    counts = label_counts(df, [*keys, ts], label)
    empty = [F.lit(0).cast("long").alias(c) for c in ("n", "known", "late")]
    full = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n", "known", "late")]
    moments = {"upper": F.col(ts) - min_lag_seconds + 1, "lower": F.col(ts) - days * DAY_SECONDS}
    rows = [F.struct(F.col(ts).alias("at"), F.lit("point").alias("role"), *full)]
    rows += [F.struct(at.alias("at"), F.lit(role).alias("role"), *empty) for role, at in moments.items()]
    rows = (
        counts.select(*keys, ts, F.explode(F.array(*rows)).alias("row"))
        .select(*keys, ts, "row.*")
        .withColumn("_block", F.floor(F.col("at") / block_seconds))
    )

    in_block = Window.partitionBy(*keys, "_block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    measures = ("n", "known", "late")

    def sums(frame, prefix: str) -> list[Column]:
        total = _Sums.over(frame)
        return [getattr(total, c).alias(f"{prefix}_{c}") for c in measures]

    blocks = rows.groupBy(*keys, "_block").agg(*[F.sum(c).alias(c) for c in measures])
    blocks = blocks.select(*keys, "_block", *sums(earlier, "before"))
    asked = rows.select(*keys, ts, "role", "_block", *sums(in_block, "within")).filter("role != 'point'")
    ends = (
        _join_null_safe(asked, blocks, [*keys, "_block"])
        .groupBy(*keys, ts)
        .agg(
            *[
                F.max(F.when(F.col("role") == role, F.col(f"within_{c}") + F.col(f"before_{c}"))).alias(f"{role}_{c}")
                for role in moments
                for c in measures
            ]
        )
    )
    upper, lower = (_Sums(*[F.col(f"{role}_{c}") for c in measures]) for role in moments)
    columns = []
    for total, (count, share) in zip([upper, upper - lower], _pairs(_column_names(name, days))):
        columns += [total.n.alias(count), total.rate().alias(share)]
    return _join_null_safe(df, ends.select(*keys, ts, *columns), [*keys, ts])


def _join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which missing values equal each other, as they do in a window.

    The right side has one row per combination, so its shuffle partitions are even and a
    row matches once at most. A hot combination can only be on the left, where adaptive
    execution splits it.
    """
    other = right.withColumnsRenamed({c: f"_other_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_other_{c}")) for c in on]
    return left.join(other, same, "left").drop(*[f"_other_{c}" for c in on])
