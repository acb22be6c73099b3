"""Edge cases of cleaning, quality, statistics, splits, preparation, evaluation and reports."""

import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tardygrade.contract import (
    FEATURES_V2, MODEL_FEATURES_V1, MODEL_FEATURES_V2, TEST_TABLES, ContractError, check_contract,
)
from tardygrade.operators import evaluate, models, prepare, quality, report, silver, split, stats
from tardygrade.operators.quantiles import exact_quantiles
from tardygrade.sources import trips


def column(df, name):
    return [r[name] for r in df.select(name).collect()]


# Contract and cleaning ------------------------------------------------------


def test_contract(spark, sf):
    source = trips(spark, sf)
    assert check_contract(source) is source
    with pytest.raises(ContractError, match="distance: missing"):
        check_contract(source.drop("distance"))
    with pytest.raises(ContractError, match="fl_date"):
        check_contract(source.withColumn("fl_date", F.col("fl_date").cast("string")))


def test_feature_lists():
    assert (len(MODEL_FEATURES_V1), len(MODEL_FEATURES_V2), len(FEATURES_V2)) == (29, 46, 53)
    assert MODEL_FEATURES_V1[9:15] == [
        "distance", "op_unique_carrier_frequency", "origin_frequency", "dest_frequency", "route_frequency", "historical_route_flights",
    ]


def test_missing_flags_mean_completed(spark):
    df = spark.createDataFrame([(None, None), (1, 1), (0, 1), (None, 1)], "cancelled int, diverted int")
    assert column(silver.flight_status(df), "flight_status") == ["Completed", "Cancelled", "Diverted", "Diverted"]
    assert quality.bad_flags(df).count() == 0
    assert quality.conflicting_flags(df).count() == 1


def test_midnight(spark):
    df = spark.createDataFrame([(t, 5, 0, 0) for t in (2400, 0, 5, 2359, 2360, -1)], "crs_dep_time int, distance int, cancelled int, diverted int")
    clean = silver.clean_midnight(df)
    assert [tuple(r) for r in clean.select("scheduled_dep_hour", "scheduled_dep_minute").collect()] == [
        (0, 0), (0, 0), (0, 5), (23, 59), (23, 60), (0, -1),
    ]
    assert column(quality.invalid_time(df), "crs_dep_time") == [2400, 2360, -1]
    assert column(quality.invalid_time(df, cleaned=True), "crs_dep_time") == [2360, -1]
    found = {r["rule"]: r["n_rows"] for r in quality.violations(df).collect()}
    assert found == {"invalid_time_raw": 3, "invalid_time_clean": 2, "bad_distance": 0, "bad_flags": 0, "conflicting_flags": 0}


def test_label_and_period(spark):
    df = spark.createDataFrame([(14, 5), (15, 6), (None, 12), (-3, 18), (0, None)], "arr_delay int, scheduled_dep_hour int")
    assert column(silver.delay_label(df), "is_delayed") == [0, 1, None, 0, 0]
    assert column(silver.day_period(df), "departure_period") == ["Night", "Morning", "Afternoon", "Evening", "Evening"]


def test_distance_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (499, 500, 999, 1000, 1499, 1500, 2499, 2500, None)], "distance int")
    assert column(stats.distance_bucket(df), "distance_bucket") == [
        "<500", "500-999", "500-999", "1000-1499", "1000-1499", "1500-2499", "1500-2499", "2500+", "2500+",
    ]


# Quality --------------------------------------------------------------------


def test_duplicate_groups(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (None, 1), (2, 5), (2, 5)], "a int, b int")
    assert quality.duplicate_groups(df).first()[0] == 2
    assert quality.duplicate_groups(df.distinct()).first()[0] == 0


def test_feature_nulls(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-float("inf"),), (1.0,)], "x double")
    assert tuple(quality.feature_nulls(df, ["x"]).first())[1:] == (2, 2)


def test_percentages_within_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 0), ("b", 1)], "g string, y int")
    got = {(r["g"], r["y"]): r["percentage"] for r in quality.pct_of_total(df, ["y"], within=["g"]).collect()}
    assert got == {("a", 0): 66.67, ("a", 1): 33.33, ("b", 1): 100.0}


@pytest.mark.parametrize("shape", ["uniform", "ties", "few", "heavy", "constant", "hot"])
def test_quantiles_are_exact(spark, shape):
    """Ranks over value ranges against NumPy."""
    rng = np.random.default_rng(5)
    values = {
        "uniform": rng.random(20_000),
        "ties": rng.integers(0, 9, 20_000).astype(float),
        "few": np.array([1.0, 2.0, 3.0, 10.0]),
        "heavy": np.exp(rng.normal(0, 8, 20_000)),
        "constant": np.full(5_000, 3.5),
        "hot": np.concatenate([np.full(9_999, 0.5), rng.random(10_001)]),
    }[shape]
    rows = [(float(v),) for v in values] + [(None,), (float("nan"),)] * 50
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "x double")
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["x"], probabilities)["x"]
    assert got == pytest.approx(np.quantile(values, probabilities), rel=1e-12)


def test_quantiles_of_many_values_are_spread(spark):
    """A million distinct values: no range of values holds much more than its share."""
    df = spark.range(0, 1_000_000, 1, 16).select(F.sin("id").alias("x"), (F.col("id") % 7).alias("y"))
    got = exact_quantiles(df, ["x", "y"], [0.5, 0.99])
    assert got["x"] == pytest.approx(np.quantile(np.sin(np.arange(1_000_000)), [0.5, 0.99]), rel=1e-9)
    assert got["y"] == [3.0, 6.0]
    counts = df.groupBy("x").count().repartitionByRange(8, "x").groupBy(F.spark_partition_id()).count()
    assert counts.agg(F.max("count")).first()[0] < 3 * 1_000_000 / 8


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert exact_quantiles(df, ["x", "y"], [0.5]) == {"x": [None], "y": [1.0]}
    assert exact_quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]}


def test_running_totals_against_brute_force(spark):
    from tardygrade.operators.ranges import running_totals

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), x, rng.randrange(5)) for x in rng.sample(range(10**9), 400)]
    df = spark.createDataFrame(rows, "k string, x long, n long")
    got = running_totals(df, [F.desc("x")], ["n"], ["k"]).collect()
    assert len(got) == len(rows)
    for k, x, n, total in got:
        assert total == sum(r[2] for r in rows if r[0] == k and r[1] >= x)
    assert running_totals(df.limit(0), [F.asc("x")], ["n"]).collect() == []


def test_grouped_medians(spark):
    from tardygrade.operators.quantiles import grouped_medians

    groups = {"one": [2.5], "two": [1.0, 4.0], "ties": [3.0] * 50 + [9.0] * 50, "none": [None, None], None: [1.0, 2.0, 7.0]}
    rows = [(k, float(v) if v is not None else None) for k, own in groups.items() for v in own]
    small = spark.createDataFrame(rows + [("one", float("nan"))], "k string, x double")
    wide = spark.range(0, 1_000_000, 1, 16).select(F.lit("wide").alias("k"), F.sin("id").alias("x"))
    got = {r["k"]: r["m"] for r in grouped_medians(small.union(wide), ["k"], "x", "m").collect()}
    want = {k: float(np.median(own)) for k, own in groups.items() if k != "none"}
    want["wide"] = float(np.median(np.sin(np.arange(1_000_000))))
    assert got == pytest.approx(want, rel=1e-12)


def test_sketch_keeps_its_rank_error(spark):
    from tardygrade.operators import quantiles

    rng = np.random.default_rng(4)
    values = np.exp(rng.normal(0, 3, 300_000))
    df = spark.createDataFrame([(float(v),) for v in np.sort(values)], "c0 double").repartition(90)
    points, upto = quantiles._sketches(df)[0]
    assert len(points) <= quantiles.POINTS and upto[-1] == pytest.approx(len(values))
    ranks = np.searchsorted(np.sort(values), points)
    assert np.abs(ranks - upto).max() <= 2 * quantiles.RANK_ERROR * len(values)


# Splits and preparation -----------------------------------------------------


def test_exact_sample(spark):
    import hashlib

    rng = random.Random(8)
    rows = [(rng.randrange(40), rng.choice(["x", "y", None])) for _ in range(500)] + [(7, "hot")] * 400
    df = spark.createDataFrame(rows, "a long, b string")
    place = lambda r: hashlib.md5("|".join("" if v is None else str(v) for v in r).encode()).hexdigest()
    for n in (0, 1, 250, 640, 899, 900, 5000):
        want = sorted(map(repr, sorted(rows, key=lambda r: (place(r), str(r)))[:n]))
        for parts in (1, 7):
            got = split.exact_sample(df.repartition(parts), n)
            assert sorted(repr(tuple(r)) for r in got.collect()) == want
    by_key = split.exact_sample(df, 100, ["a"])
    assert by_key.columns == df.columns and by_key.count() == 100
    assert split.exact_sample(df.limit(0), 5).collect() == []


def test_a_sample_stays_spread(spark):
    """The rows of the sample are filtered where they are; only totals of ranges meet in one task."""
    df = spark.range(0, 100_000, 1, 16).withColumn("x", F.col("id") % 9)
    sample = split.exact_sample(df, 40_000)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and plan.count("SinglePartition") <= 1
    assert sample.rdd.getNumPartitions() >= 16


def test_frequencies_join_the_wide_table_once(spark):
    rows = [("train", "A", "x", 1.0), ("train", "A", "y", 2.0), ("test", "B", "x", 3.0), ("test", None, "x", 4.0)]
    df = spark.createDataFrame(rows, "part string, k string, m string, wide double")
    table = split.freq_encode(df, ["k", "m"])
    got = {r["wide"]: (r["k_frequency"], r["m_frequency"]) for r in table.collect()}
    assert got == {1.0: (2, 1), 2.0: (2, 1), 3.0: (None, 1), 4.0: (None, 1)}

    def wide_joins(node):
        children = [node.children().apply(i) for i in range(node.children().size())]
        own = "Join" in node.nodeName() and any("wide" in c.output().toString() for c in children)
        return own + sum(map(wide_joins, children))

    assert wide_joins(table._jdf.queryExecution().optimizedPlan()) == 1


def test_split_edges(spark):
    days = [date(1999, 12, 31), date(2000, 1, 1), date(2000, 12, 31), date(2001, 1, 1), None]
    df = spark.createDataFrame([(d,) for d in days], "fl_date date")
    parts = column(split.temporal_split(df, TEST_TABLES.train_end, TEST_TABLES.validation_end), "part")
    assert parts == ["train", "validation", "validation", "test", None]


def test_hash_sample_ignores_partitioning(done):
    keys = ["fl_date", "route", "crs_dep_time"]
    one = split.hash_sample(done, keys, 200)
    other = split.hash_sample(done.repartition(7, F.rand(3)), keys, 200)
    assert 0 < one.count() < done.count()
    assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0


def test_bernoulli_size(done):
    n = done.count()
    assert abs(split.bernoulli(done, n=n // 2).count() - n / 2) < 4 * math.sqrt(n) / 2
    assert split.bernoulli(done, n=10 * n).count() == n


def test_unseen_category_has_no_frequency(spark):
    rows = [("a", "train"), ("a", "train"), ("b", "test"), (None, "train"), ("a", "test")]
    df = spark.createDataFrame(rows, "k string, part string")
    got = sorted(((r["k"], r["part"], r["k_frequency"]) for r in split.freq_encode(df, ["k"]).collect()), key=repr)
    assert got == sorted([("a", "train", 2), ("a", "train", 2), ("a", "test", 2), ("b", "test", None), (None, "train", None)], key=repr)


def test_impute_and_scale(spark):
    df = spark.createDataFrame([(1.0, 7.0, None), (2.0, 7.0, None), (float("nan"), 7.0, None), (10.0, None, None)], "x double, c double, e double")
    medians = prepare.fit_medians(df, ["x", "c", "e"])
    assert medians == {"x": 2.0, "c": 7.0, "e": 0.0}
    filled = prepare.impute(df, medians)
    stats = prepare.fit_scale(filled, ["x", "c", "e"])
    for c, pair in prepare.fit_scale(df, ["x", "c", "e"], medians).items():
        assert pair == pytest.approx(stats[c])
    scaled = prepare.scale(filled, stats)
    x = np.array([1.0, 2.0, 2.0, 10.0])
    assert column(scaled, "x") == pytest.approx((x - x.mean()) / x.std())
    assert column(scaled, "c") == [0.0] * 4 and column(scaled, "e") == [0.0] * 4


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,), (None,)], "is_delayed int")
    assert {r["is_delayed"]: r["weight"] for r in prepare.class_weights(df).collect()} == {0: 4 / 6, 1: 2.0}
    assert prepare.pos_weight(df).first()["scale_pos_weight"] == 3.0
    assert prepare.pos_weight(df.filter("is_delayed = 0")).first()["scale_pos_weight"] is None


# Evaluation -----------------------------------------------------------------


def scored(spark, rows):
    return spark.createDataFrame([(float(s), y) for s, y in rows], "delay_probability double, is_delayed int")


def brute_force(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap = 0.0
    for s in set(s for s, _ in rows):
        at = [y for t, y in rows if t == s]
        above = [y for t, y in rows if t >= s]
        ap += sum(at) / len(pos) * sum(above) / len(above)
    return auc, ap


def test_tied_scores(spark):
    df = scored(spark, [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)])
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(0.75)
    assert evaluate.average_precision(df).first()[0] == pytest.approx(0.75)


def test_ranking_against_brute_force(spark):
    """Close scores that share ranges and subranges, ties, and scores outside [0, 1]."""
    rng = random.Random(11)
    step = 2.0**-34
    pool = [0.5 + i * step for i in range(12)] + [0.5 + i / 65_536 for i in range(8)] + [-0.5, 0.0, 1.0, 1.5, 1e-12]
    rows = [(rng.choice(pool), int(rng.random() < 0.4)) for _ in range(250)] + [(rng.random(), rng.randrange(2)) for _ in range(100)]
    got = evaluate.ranking_metrics(scored(spark, rows)).first()
    assert tuple(got) == pytest.approx(brute_force(rows), rel=1e-12)


def test_ranking_of_a_million_margins(spark):
    """Margins of any size are dealt out evenly, and ranked as NumPy ranks them."""
    from tardygrade.operators.ranges import running_totals

    df = spark.range(0, 1_000_000, 1, 16).select(
        (F.sin("id") * 1000 + 5).alias("delay_probability"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("is_delayed")
    )
    got = evaluate.ranking_metrics(df).first()
    rows = np.array(df.orderBy(F.desc("delay_probability")).select("is_delayed").toPandas()["is_delayed"])
    positives = np.cumsum(rows)
    auc = float((positives * (1 - rows)).sum() / (rows.sum() * (1 - rows).sum()))
    ap = float((rows * positives / np.arange(1, len(rows) + 1)).sum() / rows.sum())
    assert tuple(got) == pytest.approx((auc, ap), rel=1e-9)
    ranked = evaluate.ranked_scores(df)
    assert running_totals(ranked.select("score", "pos"), [F.desc("score")], ["pos"]).count() == 1_000_000
    sizes = df.repartitionByRange(8, F.desc("delay_probability")).groupBy(F.spark_partition_id()).count()
    assert sizes.agg(F.max("count")).first()[0] < 3 * 1_000_000 / 8


def test_headline_figures_read_the_predictions_once(spark, tmp_path):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0), (0.2, None)]
    df = report.risk_category(report.predict_label(scored(spark, rows))).coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = {r["metric"]: r["value"] for r in report.model_kpis(df.mapInArrow(watched, df.schema)).collect()}
    # One job cuts the ranges, which samples the counts, and one writes them.
    assert seen.value <= 2 * len(rows)
    assert got["Total Flights"] == 6 and got["ROC-AUC"] == pytest.approx(0.75) and got["PR-AUC"] == pytest.approx(0.75)
    assert got["High-Risk Flights"] == 4 and got["Accuracy"] == pytest.approx(0.6)


def test_rows_that_break_rules_are_found(spark):
    rows = [(5, 0, 0), (0, 0, 0), (-1, 0, 0), (None, 0, 0), (5, 2, 0), (5, 0, -1), (5, None, 0), (5, 1, 1)]
    df = spark.createDataFrame(rows, "distance int, cancelled int, diverted int")
    assert sorted(r["distance"] for r in quality.bad_distance(df).collect()) == [-1, 0]
    assert sorted(tuple(r)[1:] for r in quality.bad_flags(df).collect()) == [(0, -1), (2, 0)]
    assert [tuple(r) for r in quality.conflicting_flags(df).collect()] == [(5, 1, 1)]


def test_single_class(spark):
    df = report.predict_label(scored(spark, [(0.2, 0), (0.9, 0)]))
    assert evaluate.roc_auc(df).first()[0] is None
    assert tuple(evaluate.binary_metrics(df).first()) == (0.5, 0.0, 0.0, 0.0)
    assert tuple(evaluate.baseline_metrics(df).first()) == (1.0, 0.0, 0.0, 0.0)


def test_confusion_and_report(spark):
    df = report.predict_label(scored(spark, [(0.9, 1), (0.4, 0), (0.39, 1), (0.1, 0), (0.1, 0), (0.1, None)]))
    cells = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    rows = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert rows["1"]["precision"] == 0.5 and rows["0"]["recall"] == pytest.approx(2 / 3)
    assert rows["weighted avg"]["f1"] == pytest.approx(0.4 * 0.5 + 0.6 * 2 / 3)
    assert rows["macro avg"]["support"] == 5


def test_sweep_equals_single_thresholds(spark):
    rng = random.Random(2)
    df = scored(spark, [(rng.random(), rng.randrange(2)) for _ in range(200)] + [(0.3, 1)])
    for r in evaluate.threshold_sweep(df, (0.1, 0.3, 0.99)).collect():
        one = evaluate.binary_metrics(report.predict_label(df, threshold=r["threshold"])).first()
        assert (r["precision"], r["recall"], r["f1"]) == pytest.approx(tuple(one)[1:])


# Reports --------------------------------------------------------------------


def test_risk_edges(spark):
    df = scored(spark, [(0.30, 0), (0.3000001, 0), (0.50, 0), (0.5000001, 0)])
    assert column(report.risk_category(df), "risk_category") == ["Low", "Medium", "Medium", "High"]


def test_carrier_without_predicted_delays(spark):
    df = spark.createDataFrame([("A", 1, 0, 0.1), ("A", 0, 0, 0.2)], "k string, is_delayed int, predicted_delay int, delay_probability double")
    row = report.quality_by(df, ["k"]).first()
    assert row["precision_pct"] is None and row["recall_pct"] == 0.0


def test_unknown_label_counts_as_false_negative(spark):
    df = spark.createDataFrame([(None, 1)], "is_delayed int, predicted_delay int")
    assert report.error_types(df).first()["prediction_type"] == "False Negative"
