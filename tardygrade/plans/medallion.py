"""The whole chain: source, bronze, silver, features, model, predictions, reports.

Every stage writes its table, and the next one reads it, so a lost stage is repeated
from storage. Training, scoring and evaluation stay on the executors; the driver sees
one-row results only.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..contract import FLIGHTS_2024, MODEL_FEATURES_V2, SOURCE_SCHEMA, Preset, check_contract
from ..operators import evaluate, models, report, silver, split
from ..session import materialize
from ..sources import read_between, read_table, save_json, write_catalog_table, write_table
from . import features

DASHBOARDS = ("airline_analysis", "route_analysis", "hour_analysis", "risk_analysis", "daily_analysis", "model_kpis")


def build_bronze(spark: SparkSession, source: DataFrame, base: str) -> DataFrame:
    """Store the source unchanged, after its schema is checked."""
    write_table(check_contract(source, SOURCE_SCHEMA), base, "bronze")
    return read_table(spark, base, "bronze")


def build_silver(spark: SparkSession, base: str, preset: Preset) -> DataFrame:
    write_table(silver.silver(read_table(spark, base, "bronze"), preset.delay_minutes), base, "silver")
    return read_table(spark, base, "silver")


def build_features(spark: SparkSession, base: str, preset: Preset, dense: bool = False) -> DataFrame:
    """Store both feature tables by month; the second starts from the first.

    ``dense`` is the plan for many trips per minute and keys; see ``history.attach_history``.
    """
    done = silver.completed(read_table(spark, base, "silver"))
    first = features.features_v1(done, preset.reliable_min, dense=dense)
    write_table(first, base, "features_v1", month_of="fl_date")
    stored = read_table(spark, base, "features_v1")
    write_table(features.extend_v1(stored, preset.reliable_min, dense=dense), base, "features_v2", month_of="fl_date")
    return read_table(spark, base, "features_v2")


def train(
    spark: SparkSession, base: str, preset: Preset, kind: str = "forest", sample_rows: int | None = None, **params: Any
) -> PipelineModel:
    """Fit on all training trips, or on a sample of about ``sample_rows``, and save the model."""
    table = read_between(spark, base, "features_v2", until=preset.train_end)
    if sample_rows is not None:
        # Stored, so that every pass of the fit sees the same sample.
        table = materialize(split.bernoulli(table, n=sample_rows), "sample")
    model = models.fit(table, MODEL_FEATURES_V2, kind, **{**models.FINAL[kind], **params})
    models.save(model, f"{base}/model")
    save_json(spark, MODEL_FEATURES_V2, f"{base}/feature_columns.json")
    return model


def predict(spark: SparkSession, base: str, preset: Preset) -> DataFrame:
    """Score all test trips with the saved model and store the predictions and their metrics."""
    test = read_between(spark, base, "features_v2", since=preset.validation_end)
    scored = models.score(models.load(f"{base}/model"), test)
    write_table(report.predictions(scored, threshold=preset.threshold, edges=preset.risk_edges), base, "predictions")
    stored = read_table(spark, base, "predictions")
    quality = evaluate.binary_metrics(stored).first().asDict()
    ranking = evaluate.ranking_metrics(stored).first()
    metrics = {
        **quality,
        "roc_auc": ranking["roc_auc"],
        "pr_auc": ranking["average_precision"],
        "threshold": preset.threshold,
    }
    save_json(spark, metrics, f"{base}/metrics.json")
    return stored


def write_reports(
    spark: SparkSession, base: str, preset: Preset, table_name: Callable[[str], str] | None = None
) -> list[str]:
    """Store the tables that dashboards read, in the catalog too if ``table_name`` names them there."""
    scored = read_table(spark, base, "predictions")
    tables = {
        "airline_analysis": report.airline_risk(scored),
        "route_analysis": report.route_risk(scored, preset.route_test_min),
        "hour_analysis": report.hour_risk(scored),
        "risk_analysis": report.risk_table(scored),
        "daily_analysis": report.daily_trend(scored),
        "model_kpis": report.model_kpis(scored),
    }
    paths = [write_table(table, base, name) for name, table in tables.items()]
    if table_name is not None:
        for name in tables:
            write_catalog_table(read_table(spark, base, name), table_name(name))
    return paths


def run(
    spark: SparkSession,
    source: DataFrame,
    base: str,
    preset: Preset = FLIGHTS_2024,
    *,
    dense: bool = False,
    table_name: Callable[[str], str] | None = None,
    **model_params: Any,
) -> list[str]:
    """All stages in order; returns the paths of the report tables."""
    build_bronze(spark, source, base)
    build_silver(spark, base, preset)
    build_features(spark, base, preset, dense)
    train(spark, base, preset, **model_params)
    predict(spark, base, preset)
    return write_reports(spark, base, preset, table_name)
