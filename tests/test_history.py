"""Window edges and properties of the history features."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tardygrade.operators import history
from tardygrade.operators.history import ALL_ENTITIES, CONTEXT_ENTITIES, DAY_ENTITIES, Context, Entity
from tardygrade.plans import features

SCHEMA = "fl_date date, scheduled_dep_hour int, scheduled_dep_minute int, day_of_week int, origin string, is_delayed int"
ORIGIN = Entity("origin", "origin")
ORIGIN_HOUR = Entity("origin", "origin", None, (Context("origin_hour", "scheduled_dep_hour", 7),))


def trips_of(spark, rows):
    """Rows of (day, hour, minute, origin, label)."""
    full = [(d, h, m, d.isoweekday(), o, y) for d, h, m, o, y in rows]
    return spark.createDataFrame(full, SCHEMA)


def in_order(df, *cols):
    return [tuple(r) for r in df.orderBy("fl_date", "scheduled_dep_hour", "scheduled_dep_minute").select(*cols).collect()]


def test_gaps_between_days(spark):
    days = [date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 9), date(2024, 1, 16)]
    df = trips_of(spark, [(d, 8, 0, "A", y) for d, y in zip(days, [1, 0, 1, 0])])
    got = in_order(history.attach_history(df, [ORIGIN]), *ORIGIN.columns)
    assert got == [
        (None, None, None, None),
        (1, 1.0, 1, 1.0),
        (2, 0.5, 1, 0.0),
        (3, pytest.approx(2 / 3), 1, 1.0),
    ]


def test_same_minute_does_not_count(spark):
    df = trips_of(spark, [(date(2024, 1, 1), 8, 0, "A", 1), (date(2024, 1, 1), 8, 0, "A", 0)])
    got = in_order(history.attach_history(df, [ORIGIN_HOUR]), *ORIGIN_HOUR.contexts[0].columns)
    assert got == [(0, None, 0, None)] * 2


def test_same_day_counts_for_contexts_only(spark):
    df = trips_of(spark, [(date(2024, 1, 1), 8, 0, "A", 1), (date(2024, 1, 1), 8, 1, "A", 0)])
    both = Entity("origin", "origin", 7, ORIGIN_HOUR.contexts)
    got = in_order(history.attach_history(df, [both]), "historical_origin_flights", "historical_origin_hour_flights")
    assert got == [(None, 0), (None, 1)]


def test_exactly_seven_days(spark):
    start = date(2024, 1, 1)
    df = trips_of(
        spark, [(start, 8, 0, "A", 1), (start, 8, 1, "A", 1), (start + timedelta(days=7), 8, 1, "A", 0)]
    )
    got = in_order(history.attach_history(df, [ORIGIN_HOUR]), *ORIGIN_HOUR.contexts[0].columns)
    assert got[-1] == (2, 1.0, 1, 1.0)


def test_unknown_labels_are_counted_but_not_summed(spark):
    start = date(2024, 1, 1)
    df = trips_of(spark, [(start + timedelta(days=i), 8, 0, "A", y) for i, y in enumerate([None, None, 1, 0])])
    both = Entity("origin", "origin", 7, ORIGIN_HOUR.contexts)
    got = in_order(history.attach_history(df, [both]), *both.columns, *both.contexts[0].columns)
    day = [(None, None, None, None), (1, None, 1, None), (2, None, 2, None), (3, 1 / 3, 3, 1 / 3)]
    ctx = [(0, None, 0, None), (1, None, 1, None), (2, None, 2, None), (3, 1 / 3, 3, 1 / 3)]
    assert got == [d + c for d, c in zip(day, ctx)]


def test_missing_keys(spark):
    df = trips_of(spark, [(date(2024, 1, 1), 8, 0, None, 1), (date(2024, 1, 2), 8, 0, None, 0)])
    both = Entity("origin", "origin", 7, ORIGIN_HOUR.contexts)
    got = in_order(history.attach_history(df, [both]), "historical_origin_flights", "historical_origin_hour_flights")
    assert got == [(None, 0), (None, 1)]


def test_dates_before_1970(spark):
    days = [date(1969, 12, 30), date(1969, 12, 31), date(1970, 1, 1)]
    df = trips_of(spark, [(d, 8, 5, "A", 1) for d in days])
    got = in_order(history.attach_history(df, [ORIGIN_HOUR]), "historical_origin_hour_flights")
    assert got == [(0,), (1,), (2,)]


def test_min_lag_closes_the_same_day_leak(spark):
    lagged = Entity("origin", "origin", None, (Context("origin_hour", "scheduled_dep_hour", None, 86_400),))
    df = trips_of(spark, [(date(2024, 1, 1), 8, 0, "A", 1), (date(2024, 1, 1), 8, 30, "A", 1), (date(2024, 1, 2), 8, 0, "A", 1)])
    assert in_order(history.attach_history(df, [lagged]), "historical_origin_hour_flights") == [(0,), (0,), (1,)]


def test_brute_force_on_random_trips(spark):
    """All frames against a plain count over earlier rows, with one key that holds most of them."""
    import random

    rng = random.Random(7)
    rows = [
        (date(2024, 1, 1) + timedelta(days=rng.randrange(30)), rng.randrange(3), rng.randrange(3) * 20,
         "hot" if rng.random() < 0.6 else rng.choice("AB"), rng.choice([0, 1, None]))
        for _ in range(400)
    ]
    both = Entity("origin", "origin", 7, (Context("origin_hour", "scheduled_dep_hour", 7), Context("origin_dow", "day_of_week")))
    columns = [c for part in both.parts for c in part.columns]
    table = history.attach_history(trips_of(spark, rows), [both])
    got = [tuple(r) for r in table.select("fl_date", "scheduled_dep_hour", "scheduled_dep_minute", "origin", "is_delayed", *columns).collect()]

    def seconds(r):
        return (r[0] - date(1970, 1, 1)).days * 86_400 + r[1] * 3_600 + r[2] * 60

    def count(earlier, empty):
        known = [r[4] for r in earlier if r[4] is not None]
        return (len(earlier) or empty), (sum(known) / len(earlier) if known else None)

    want = []
    for r in rows:
        same = [x for x in rows if x[3] == r[3]]
        days = [x for x in same if x[0] < r[0]]
        hour = [x for x in same if x[1] == r[1] and seconds(x) < seconds(r)]
        dow = [x for x in same if x[0].isoweekday() == r[0].isoweekday() and seconds(x) < seconds(r)]
        want.append(
            r
            + count(days, None)
            + count([x for x in days if (r[0] - x[0]).days <= 7], None)
            + count(hour, 0)
            + count([x for x in hour if seconds(r) - seconds(x) <= 604_800], 0)
            + count(dow, 0)
        )
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_dense_plan_gives_the_same_rows(done):
    for entities in (DAY_ENTITIES, ALL_ENTITIES):
        plain = history.attach_history(done, entities)
        dense = history.attach_history(done, entities, dense=True)
        assert plain.count() == done.count()
        assert plain.exceptAll(dense).count() == 0 and dense.exceptAll(plain).count() == 0


def test_partitioning_does_not_matter(done):
    plain = history.attach_history(done, CONTEXT_ENTITIES)
    moved = history.attach_history(done.repartition(13, F.rand(1)), CONTEXT_ENTITIES)
    assert plain.exceptAll(moved).count() == 0


def test_two_hops_equal_one(done):
    one = features.features_v2(done)
    two = features.extend_v1(features.features_v1(done))
    assert one.columns == two.columns and len(one.columns) == 53
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


@pytest.fixture(scope="module")
def odd_times(spark, sf):
    """Completed trips, some without a date or departure time, or with times that do not exist."""
    from tardygrade.operators import silver
    from tardygrade.session import materialize
    from tardygrade.sources import trips

    kind = F.col("distance") % 13
    time = F.when(kind == 0, F.lit(None)).when(kind == 1, -1).when(kind == 2, 2360).otherwise(F.col("crs_dep_time"))
    changed = trips(spark, sf).withColumn("crs_dep_time", time.cast("int"))
    changed = changed.withColumn("day_of_week", F.when(kind == 3, F.lit(None)).otherwise(F.col("day_of_week")))
    changed = changed.withColumn("fl_date", F.when(kind == 4, F.lit(None)).otherwise(F.col("fl_date")))
    return materialize(silver.completed(silver.silver(changed)), "odd_times")


def test_two_hops_equal_one_for_odd_times(odd_times):
    one = features.features_v2(odd_times)
    two = features.extend_v1(features.features_v1(odd_times))
    assert one.count() == odd_times.count()
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_missing_and_invalid_times(spark):
    """A trip never counts for another of the same or an earlier day because of its time."""
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(5)]
    times = [(8, 0), (0, -1), (8, 0), (None, None), (23, 60)]
    df = trips_of(spark, [(d, h, m, "A", 1) for d, (h, m) in zip(days, times)])
    both = Entity("origin", "origin", 7, ORIGIN_HOUR.contexts)
    table = history.attach_history(df, [both]).orderBy("fl_date")
    got = [tuple(r) for r in table.select("historical_origin_flights", "historical_origin_hour_flights").collect()]
    assert got == [(None, 0), (1, 0), (2, 1), (3, 0), (4, 0)]

    alone = trips_of(spark, [(days[0], 8, 0, "A", 1)]).union(
        spark.createDataFrame([(None, 8, 0, 1, "A", 1)], SCHEMA)
    )
    rows = {r["fl_date"]: r for r in history.attach_history(alone, [both]).collect()}
    assert rows[days[0]]["historical_origin_flights"] is None and rows[days[0]]["historical_origin_hour_flights"] == 0
    assert rows[None]["historical_origin_flights"] is None and rows[None]["historical_origin_hour_flights"] == 0


def test_key_filter_reaches_the_scan(done):
    table = history.history_for_key(done, ORIGIN_HOUR, {"origin": "NATION_12", "scheduled_dep_hour": 12})
    full = history.attach_history(done, [ORIGIN_HOUR]).filter("origin = 'NATION_12' AND scheduled_dep_hour = 12")
    assert table.exceptAll(full).count() == 0 and full.exceptAll(table).count() == 0


def test_density(done):
    doubled = done.union(done)
    ratio = history.grain_density(doubled) / history.grain_density(done)
    assert ratio == pytest.approx(2, rel=0.01)


def test_blocks_equal_one_window(spark):
    """Sums by block against one window per key, for a key with most of the points and ties."""
    import random

    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else "cold", rng.randrange(3_000), rng.choice([0, 1, None]), i) for i in range(500)]
    rows += [(None, 5, 1, 500), (None, 9, 0, 501)]
    df = spark.createDataFrame(rows, "k string, ts long, is_delayed int, id int")
    from pyspark.sql import Window

    whole = Window.partitionBy("k").orderBy("ts")
    for lag, block in ((1, 100), (60, 100), (1, 7)):
        got = history.attach_second_history(df, ["k"], "k", "ts", days=1, min_lag_seconds=lag, block_seconds=block)
        before = whole.rangeBetween(Window.unboundedPreceding, -lag)
        want = df.select("id", F.count("*").over(before).alias("n"), F.sum("is_delayed").over(before).alias("d"))
        pairs = got.join(want, "id").select("historical_k_flights", "historical_k_delay_rate", "n", "d", "k_flights_last_1d").collect()
        assert len(pairs) == len(rows)
        for n, share, want_n, want_d, last in pairs:
            assert n == want_n == last
            assert share == (None if want_d is None else pytest.approx(want_d / want_n))


def test_blocks_trailing_edge(spark):
    week = 604_800
    df = spark.createDataFrame([("A", 0, 1), ("A", 1, 1), ("A", week + 1, 0)], "k string, ts long, is_delayed int")
    got = history.attach_second_history(df, ["k"], "k", "ts").filter(F.col("ts") == week + 1).first()
    assert (got["historical_k_flights"], got["k_flights_last_7d"]) == (2, 1)
