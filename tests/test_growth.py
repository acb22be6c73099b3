"""What is shuffled and written: bounded by the plan, whatever the size of the tables."""

import sys
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import tardygrade.catalog  # noqa: F401
from tardygrade import session
from tardygrade.contract import FEATURES_V2
from tardygrade.operators import blocks, history, models, quality, split
from tardygrade.sources import trips

QUERIES = sys.modules["tardygrade.catalog.queries"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stored_tables_are_not_shuffled_again(spark, sf, monkeypatch):
    built = []
    monkeypatch.setattr(QUERIES, "_STORED", {})
    monkeypatch.setattr(QUERIES, "materialize", lambda df, label: built.append(plan_of(df)) or df)
    QUERIES._trips(spark, sf), QUERIES._silver(spark, sf)
    assert len(built) == 2 and not any("Rebalance" in plan for plan in built)


def test_joins_of_order_lines_are_narrow(spark, sf):
    """Prices and timestamps stay below the first join."""
    join = [line for line in plan_of(trips(spark, sf)).splitlines() if "Project" in line and "l_extendedprice" in line]
    assert len(join) == 1 and "FLOOR((l_extendedprice" in join[0]


def test_files_of_stored_tables_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(session, "FILE_ROWS", 10)
    table = session.materialize(spark.range(0, 95, 1, 1), "bounded")
    assert len(table.inputFiles()) == 10 and table.count() == 95


def test_trips_are_shuffled_once_for_all_histories(done):
    """One shuffle of the wide trips, reused for the counts, and no join with them."""
    table = history.attach_history(done.select(*QUERIES.TRIP, "distance"), history.ALL_ENTITIES)
    text = table._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text
    wide = table._jdf.queryExecution().optimizedPlan().toString()
    laid = [line for line in wide.splitlines() if "RepartitionByExpression [_group" in line]
    # The trips themselves, and the rows that each of three counts and two moved parts take from them.
    assert len(laid) >= 4
    below = [line.split("Project ", 1)[1] for line in wide.splitlines() if "Project [" in line and "AS _group" in line and "distance" in line]
    assert len({len(line.split(",")) for line in below}) == 1


def test_groups_have_a_bounded_number_of_days(spark, monkeypatch):
    """The result is the same for a day at a time and for all days together."""
    rows = [(date(2024, 1, 1) + timedelta(days=k % 23), k % 5, k * 7 % 60, k % 7, "AB"[k % 2], k % 3 % 2) for k in range(300)]
    schema = "fl_date date, scheduled_dep_hour int, scheduled_dep_minute int, day_of_week int, origin string, is_delayed int"
    df = spark.createDataFrame(rows, schema)
    contexts = (history.Context("origin_hour", "scheduled_dep_hour", 7), history.Context("origin_dow", "day_of_week", 3, 90_000))
    found = []
    for together in (1, 60, 1 << 16):
        monkeypatch.setattr(history, "TOGETHER", together)
        found.append(sorted(map(repr, history.attach_history(df, [history.Entity("origin", "origin", 7, contexts)]).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 300


def test_sums_of_contexts_do_not_grow_with_days(spark, monkeypatch):
    """One row for a key and hour of a group of days, and points only from the days before a group."""
    rows = [(date(2024, 1, 1) + timedelta(days=d), h, 0, 1, "A", 0) for d in range(200) for h in range(4)]
    schema = "fl_date date, scheduled_dep_hour int, scheduled_dep_minute int, day_of_week int, origin string, is_delayed int"
    counts = []
    before = history._sums_before
    monkeypatch.setattr(history, "_sums_before", lambda df, *rest: counts.append(df) or before(df, *rest))
    monkeypatch.setattr(history, "_group_width", lambda *_: 50)
    one = history.Entity("origin", "origin", None, (history.Context("origin_hour", "scheduled_dep_hour", 7),))
    table = history.attach_history(spark.createDataFrame(rows, schema), [one])
    last = table.filter("fl_date = '2024-07-18' and scheduled_dep_hour = 3").select(*one.contexts[0].columns).first()
    assert tuple(last) == (199, 0.0, 7, 0.0)
    assert counts[0].count() <= (200 // 50 + 2) * 4


def test_wide_rows_are_not_shuffled_for_few_copies(spark):
    """the rows are compared with the few hashes that repeat, wherever they lie."""
    once = spark.range(0, 1 << 21, 1, 4).selectExpr("id", "id % 7 AS a", "id % 11 AS b")
    table = quality.duplicate_groups(once.unionByName(once.filter("id < 3")))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert table.first()[0] == 3


def test_stored_features_have_no_derived_columns(spark, sf, monkeypatch):
    """Masked rates, flags and calendar columns follow from others and are not written."""
    built = {}
    monkeypatch.setattr(QUERIES, "_STORED", {})
    monkeypatch.setattr(QUERIES, "materialize", lambda df, label: built.setdefault(label, df))
    table = QUERIES._stored_features(spark, sf)
    written = built["histories"].columns
    assert not [c for c in written if c.startswith(("reliable_", "has_", "is_weekend", "dep_hour_", "month_"))]
    assert len(written) <= len(FEATURES_V2) + 1 - 14 and table.columns == [*FEATURES_V2, "part"]


def test_few_rows_are_fitted_by_few_tasks(spark, monkeypatch):
    """Each task sends statistics of all nodes, so tasks follow the rows and not the files."""
    seen = []

    class Seen(models.Pipeline):
        def fit(self, df):
            return seen.append(df.rdd.getNumPartitions())

    monkeypatch.setattr(models, "Pipeline", Seen)
    train = spark.range(0, 3000, 1, 50).selectExpr("id % 2 AS is_delayed", "id AS a")
    models.fit(train, ["a"], "forest", numTrees=2)
    assert seen == [3]


def test_histories_store_narrow_trips(spark, sf, monkeypatch):
    """only the columns that histories depend on are carried through the joins and written."""
    built = {}
    monkeypatch.setattr(QUERIES, "_STORED", {})
    monkeypatch.setattr(QUERIES, "materialize", lambda df, label: built.setdefault(label, df))
    QUERIES._REGISTRY["ctx_origin_dow"](spark, sf), QUERIES._REGISTRY["odd_time_history"](spark, sf)
    assert {label: len(df.columns) for label, df in built.items()} == {"history_trips": 8, "odd_times": 9}
    QUERIES._silver(spark, sf)
    assert QUERIES._history_trips(spark, sf).columns == QUERIES.TRIP


def test_models_store_no_training_rows_beyond_the_sample(spark, sf, monkeypatch):
    """the sample is that of all training rows, the other parts are whole, and few training rows are written."""
    monkeypatch.setattr(QUERIES, "LABELLED_ROWS", 50)
    monkeypatch.setattr(QUERIES, "_STORED", {})
    table = QUERIES._model_features(spark, sf)
    assert {name for *_, name in QUERIES._STORED} == {"feature_trips", "model_histories"}
    monkeypatch.setattr(QUERIES, "_STORED", {})
    whole = QUERIES._stored_features(spark, sf)
    assert table.columns == whole.columns
    for part in ("validation", "test"):
        ours, all_rows = split.part_of(table, part), split.part_of(whole, part)
        assert ours.count() and not ours.exceptAll(all_rows).count() and not all_rows.exceptAll(ours).count()
    ours, train = split.part_of(table, "train"), split.part_of(whole, "train")
    assert 50 <= ours.count() < train.count() / 5
    samples = [sorted(map(repr, split.exact_sample(df, 50).collect())) for df in (ours, train)]
    assert samples[0] == samples[1] and len(samples[0]) == 50


def test_models_read_all_training_rows_if_too_few_are_in_reach(spark, sf, monkeypatch):
    monkeypatch.setattr(QUERIES, "LABELLED_ROWS", 50)
    monkeypatch.setattr(QUERIES, "_STORED", {})
    monkeypatch.setattr(split, "sample_reach", lambda rows, n: 0)
    found = QUERIES._model_features(spark, sf)
    assert found.count() == QUERIES._stored_features(spark, sf).count()


def test_feature_trips_are_narrow(spark, sf, monkeypatch):
    """neither the joins nor the stored trips carry columns that the feature table does not take over."""
    built = {}
    monkeypatch.setattr(QUERIES, "_STORED", {})
    monkeypatch.setattr(QUERIES, "materialize", lambda df, label: built.setdefault(label, df))
    QUERIES._stored_features(spark, sf)
    assert list(built) == ["feature_trips", "histories"] and set(built["feature_trips"].columns) <= set(FEATURES_V2)
    QUERIES._silver(spark, sf)
    assert QUERIES._feature_trips(spark, sf).columns == built["feature_trips"].columns


def test_models_are_fitted_on_all_training_rows(spark, sf, monkeypatch):
    """No fit takes a sample of the training part, and none a column too few."""
    seen = []
    monkeypatch.setattr(QUERIES, "LABELLED_ROWS", 50)
    monkeypatch.setattr(QUERIES, "_STORED", {})
    monkeypatch.setattr(QUERIES, "_MODELS", {})
    monkeypatch.setattr(models, "fit", lambda train, cols, kind, **_: seen.append((kind, train.select(*cols).count())))
    for first in (False, True):
        for kind in ("logistic", "forest", "boosted"):
            QUERIES._model(spark, sf, kind, first)
    rows = split.part_of(QUERIES._stored_features(spark, sf), "train").count()
    assert rows > 1000 and seen == 2 * [("logistic", rows), ("forest", rows), ("boosted", rows)]


def test_groups_fit_a_task(spark):
    """No group has more trips than are put together, unless one day has."""
    rows = spark.range(0, 1 << 20, 1, 8).selectExpr("id", "date_add(DATE'2024-01-01', CAST(id % 14 AS int)) AS fl_date")
    assert history._group_width(rows, "fl_date", 7) == 1
    assert history._group_width(rows.filter("id % 16 = 0"), "fl_date", 7) == 7


def test_large_groups_come_back_in_small_batches():
    """Spark holds a batch at a time, and neighbours are alike, so that they take little room when stored."""
    n = 3 * blocks.BATCH
    trips = pa.table({"day": pa.array(np.arange(n) % 2, pa.int32()).cast(pa.date32()), "key": [f"k{i % 3}" for i in range(n)], "late": np.zeros(n, np.int64), "i": np.arange(n)})
    info = pa.table({"_kind": pa.array([], pa.int32()), "key": pa.array([], pa.string()), "_order": pa.array([], pa.int64())})
    part = blocks.DayPart(1, "key", 7, ("n", "r", "n7", "r7"))
    layout = blocks.Layout("day", "late", (), 2, 0)
    found = blocks.attached([part], ["day", "key", "i"], layout)((pa.scalar(0),), trips, info)
    assert max(b.num_rows for b in found.to_batches()) <= blocks.BATCH
    assert sorted(found["i"].to_pylist()) == list(range(n))
    pairs = list(zip(found["day"].to_pylist(), found["key"].to_pylist()))
    assert sum(a != b for a, b in zip(pairs, pairs[1:])) == 5


def test_stored_histories_have_late_trips_for_rates(spark, sf, monkeypatch):
    """Whole numbers take less room; the rates come back bit for bit."""
    built = {}
    monkeypatch.setattr(QUERIES, "_STORED", {})
    monkeypatch.setattr(QUERIES, "materialize", lambda df, label: built.setdefault(label, df))
    table = QUERIES._stored_features(spark, sf)
    rates = [f.name for f in built["histories"].schema if f.dataType.typeName() == "double"]
    assert not [c for c in rates if c != "distance"] and not [c for c in built["histories"].columns if "delay_rate" in c]
    whole = QUERIES._derived(QUERIES._build_histories(spark, sf))
    assert table.schema == whole.schema
    assert not table.exceptAll(whole).count() and not whole.exceptAll(table).count()


def test_shuffles_go_when_a_stage_table_is_written(spark, tmp_path, monkeypatch):
    """The disk holds the shuffles of one stage at a time."""
    seen = []
    monkeypatch.setattr(session, "_shuffles_dropped", lambda s, inner=session._shuffles_dropped: seen.append(s) or inner(s))
    before = spark.conf.get(session.DROP_SHUFFLES)
    table = QUERIES.materialize(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "dropped")
    assert table.count() == 7 and len(seen) == 1 and spark.conf.get(session.DROP_SHUFFLES) == before
    assert all(".zstd." in f for f in table.inputFiles())


def test_features_v2_stores_narrow_trips(spark, sf, monkeypatch):
    """of the trips only what the feature table takes over."""
    monkeypatch.setattr(QUERIES, "_STORED", {})
    QUERIES._REGISTRY["features_v2"](spark, sf)
    assert {name for *_, name in QUERIES._STORED} == {"feature_trips"}


def test_combinations_are_counted_once(spark, sf, monkeypatch):
    """one pass over the wide rows gives the frequencies and the combinations, for fit and scores."""
    calls = []
    monkeypatch.setattr(QUERIES, "_STORED", {})
    monkeypatch.setattr(split, "freq_encode", lambda df, encode=split.freq_encode: calls.append(1) or encode(df))
    monkeypatch.setattr(split, "materialize", lambda df, label: calls.append(label) or session.materialize(df, label))
    assert QUERIES._model_inputs(spark, sf, True) is QUERIES._model_inputs(spark, sf, True)
    assert calls == [1, "counted_combinations", "frequencies", "combinations"]
