"""Models, tables and the whole chain on the smallest test tables."""

import pytest
from pyspark.sql import functions as F

from tardygrade.contract import MODEL_FEATURES_V2, PREDICTIONS, TEST_TABLES
from tardygrade.operators import evaluate, models, split
from tardygrade.plans import features, medallion
from tardygrade.session import materialize, shared_folder
from tardygrade.sources import (
    current_path, drop_table, identity, load_json, read_between, read_table, rows_frame, save_json, table_exists,
    table_path, table_profile, table_shapes, trips, write_catalog_table, write_table,
)

SMALL = {"numTrees": 10, "maxDepth": 5}


@pytest.fixture(scope="module")
def parts(done):
    table = split.temporal_split(features.features_v2(done), TEST_TABLES.train_end, TEST_TABLES.validation_end)
    stored = materialize(table, "features")
    return [split.part_of(stored, name) for name in split.PARTS]


@pytest.mark.parametrize(
    ("kind", "params"),
    [("logistic", {"maxIter": 50}), ("forest", SMALL), ("boosted", {"maxIter": 5, "maxDepth": 3, "stepSize": 0.3})],
)
def test_models_find_the_signal(parts, kind, params):
    train, validation, _ = parts
    scored = models.score(models.fit(train, MODEL_FEATURES_V2, kind, **params), validation)
    assert scored.columns == [*validation.columns, "delay_probability"]
    assert evaluate.roc_auc(scored).first()[0] > 0.6


def test_fit_is_repeatable_and_survives_saving(spark, parts, tmp_path):
    train, _, test = parts
    first = models.fit(train, MODEL_FEATURES_V2, "forest", **SMALL)
    again = models.fit(train, MODEL_FEATURES_V2, "forest", **SMALL)
    models.save(first, str(tmp_path / "model"))
    both = models.score(models.load(str(tmp_path / "model")), models.score(first, test, "a"), "b")
    both = models.score(again, both, "c")
    assert both.filter("a != b OR a != c").count() == 0
    top = models.importance(first, MODEL_FEATURES_V2, 20, spark).collect()
    assert len(top) == 20 and top[0]["importance"] >= top[-1]["importance"]


def test_tables(spark, sf, tmp_path):
    base = str(tmp_path)
    source = trips(spark, sf)
    write_table(source, base, "plain")
    write_table(source.select("fl_date"), base, "plain")
    assert read_table(spark, base, "plain").columns == ["fl_date"]

    write_table(source, base, "by_month", month_of="fl_date")
    back = read_table(spark, base, "by_month")
    assert back.columns == source.columns
    assert back.exceptAll(source).count() == 0 and back.count() == source.count()
    some = read_between(spark, base, "by_month", TEST_TABLES.train_end, TEST_TABLES.validation_end)
    assert some.count() == source.filter("fl_date >= '2000-01-01' AND fl_date < '2001-01-01'").count()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "part_month" in plan.split("PartitionFilters")[1].split("]")[0]

    profile = table_profile(spark, table_path(base, "by_month")).first()
    assert profile["n_rows"] == source.count() and profile["n_files"] > 12 and profile["n_bytes"] > 0
    shapes = {r["table_name"]: (r["n_rows"], r["n_columns"]) for r in table_shapes({"x": back, "y": some}).collect()}
    assert shapes["x"] == (source.count(), len(source.columns))


def test_a_failed_write_keeps_the_old_rows(spark, tmp_path):
    base = str(tmp_path)
    old = rows_frame(spark, [("2000-01-01", 1), ("2000-02-01", 2)], "day string, n int").selectExpr("cast(day AS date) AS day", "n")
    for month_of in (None, "day"):
        name = f"table_{month_of}"
        path = table_path(base, name)
        write_table(old, base, name, month_of)
        bad = old.selectExpr("day", "n", "IF(n = 2, raise_error('broken'), 0) AS extra")
        with pytest.raises(Exception, match="broken"):
            write_table(bad, base, name, month_of)
        assert sorted(read_table(spark, base, name).collect()) == sorted(old.collect())
        # What the failed write had begun is gone, and a folder without a marker is not read.
        assert len([f for f in (tmp_path / f"{name}.parquet").iterdir() if f.name.startswith("data-")]) == 1
        old.write.parquet(f"{path}/data-lost")
        assert read_table(spark, base, name).count() == 2


def test_versions(spark, tmp_path):
    base = str(tmp_path)
    path = table_path(base, "t")
    one = rows_frame(spark, [(1,)], "n int")
    # A table without versions is replaced by one with them.
    one.write.parquet(path)
    write_table(read_table(spark, base, "t").selectExpr("n + 1 AS n"), base, "t")
    reading = read_table(spark, base, "t")
    # A table computed from itself; whoever reads the version before goes on reading it.
    write_table(reading.selectExpr("n + 1 AS n", "'x' AS more"), base, "t")
    assert reading.collect() == [(2,)]
    assert read_table(spark, base, "t").collect() == [(3, "x")]
    for n in range(4, 13):
        write_table(rows_frame(spark, [(n,)], "n int"), base, "t")
        assert read_table(spark, base, "t").collect() == [(n,)]
    assert sorted(f.name.split("-")[0] for f in (tmp_path / "t.parquet").iterdir()) == ["_versions", "data", "data"]
    assert table_profile(spark, path).first()["n_rows"] == 1
    assert current_path(spark, table_path(base, "none")) == table_path(base, "none")


def test_models_of_two_inputs_lie_apart(spark, parts, tmp_path):
    train, _, test = parts
    fitted = {}
    for half in (0, 1):
        rows = train.filter(F.expr(f"pmod(xxhash64(route), 2) = {half}"))
        model = models.fit(rows, MODEL_FEATURES_V2, "forest", **SMALL)
        path = models.artefact_path(str(tmp_path), "forest", half=half, **SMALL)
        assert path == models.artefact_path(str(tmp_path), "forest", **SMALL, half=half)
        models.save(model, path)
        fitted[path] = model
    assert len(fitted) == 2
    for path, model in fitted.items():
        both = models.score(models.load(path), models.score(model, test, "a"), "b")
        assert both.filter("a IS DISTINCT FROM b").count() == 0


def test_identity_follows_the_files(spark, tmp_path):
    base = str(tmp_path)
    first = identity(spark, base)
    rows_frame(spark, [(1,)], "n int").write.parquet(f"{base}/t")
    second = identity(spark, base)
    rows_frame(spark, [(2,)], "n int").write.mode("overwrite").parquet(f"{base}/t")
    assert len({first, second, identity(spark, base)}) == 3


def test_catalog_tables(spark, tmp_path):
    name = "tardygrade_catalog_test"
    drop_table(spark, name)
    assert not table_exists(spark, name)
    frame = rows_frame(spark, [("a", 1.0)], "metric string, value double")
    write_catalog_table(frame, name)
    assert table_exists(spark, name) and spark.table(name).collect() == frame.collect()
    drop_table(spark, name)
    assert not table_exists(spark, name)


def test_json(spark, tmp_path):
    save_json(spark, ["a", "b"], str(tmp_path / "list"))
    save_json(spark, {"accuracy": 0.5, "roc_auc": None, "threshold": 0.4}, str(tmp_path / "map"))
    assert load_json(spark, str(tmp_path / "list")) == ["a", "b"]
    assert load_json(spark, str(tmp_path / "map"))["threshold"] == 0.4


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (configured or spark.sparkContext.getCheckpointDir())


def test_whole_chain(spark, sf, tmp_path):
    base = str(tmp_path)
    names = "tardygrade_{}_test".format
    paths = medallion.run(spark, trips(spark, sf), base, TEST_TABLES, table_name=names, **SMALL)
    for name in medallion.DASHBOARDS:
        assert spark.table(names(name)).exceptAll(read_table(spark, base, name)).count() == 0
        drop_table(spark, names(name))
    assert [p.rsplit("/", 1)[1] for p in paths] == [f"{name}.parquet" for name in medallion.DASHBOARDS]
    scored = read_table(spark, base, "predictions")
    assert scored.columns == PREDICTIONS
    kpis = {r["metric"]: r["value"] for r in read_table(spark, base, "model_kpis").collect()}
    metrics = load_json(spark, f"{base}/metrics.json")
    assert len(kpis) == 11 and kpis["Total Flights"] == scored.count()
    assert kpis["ROC-AUC"] == pytest.approx(metrics["roc_auc"]) and kpis["ROC-AUC"] > 0.6
    assert load_json(spark, f"{base}/feature_columns.json") == MODEL_FEATURES_V2
    daily = read_table(spark, base, "daily_analysis").agg(F.sum("total_flights")).first()[0]
    assert daily == scored.count()
