"""Classifiers as Spark ML pipelines: preprocessing and model are fitted, saved and applied together."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .prepare import class_weights, fit_medians, fit_scale, pos_weight

WEIGHT = "_weight"
# Training rows of a task, at least.
TASK_ROWS = 1 << 10

# Settings of the trained models.
FOREST_V1 = {"numTrees": 150, "maxDepth": 15}
FOREST_V2 = {"numTrees": 200, "maxDepth": 12}
FOREST_FINAL = {"numTrees": 300, "maxDepth": 12}
LOGISTIC_V1 = {"maxIter": 1000}
LOGISTIC_V2 = {"maxIter": 2000}
BOOSTED_V1 = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "minInstancesPerNode": 10}
BOOSTED_V2 = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05}

# The settings of a final model of each kind.
FINAL = {"logistic": LOGISTIC_V2, "forest": FOREST_FINAL, "boosted": BOOSTED_V2}

_DEFAULTS: dict[str, dict[str, Any]] = {
    "logistic": {"elasticNetParam": 0.0, "standardization": False},
    "forest": {"minInstancesPerNode": 20, "featureSubsetStrategy": "sqrt", "seed": 42},
    "boosted": {"subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42},
}
_CLASSES = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "boosted": GBTClassifier}


def preprocessing(train: DataFrame, cols: Sequence[str]) -> SQLTransformer:
    """Median imputation and standard scaling as one projection that is saved with the model."""
    medians = fit_medians(train, cols)
    scales = fit_scale(train, cols, medians)
    missing = "nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE))"
    inputs = [
        f"(coalesce({missing.format(c=c)}, {medians[c]!r}D) - {scales[c][0]!r}D) / {scales[c][1]!r}D AS `{input_name(c)}`"
        for c in cols
    ]
    return SQLTransformer(statement=f"SELECT *, {', '.join(inputs)} FROM __THIS__")


def input_name(col: str) -> str:
    return f"in_{col}"


def feature_vector(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Adds the ordered input vector ``features``, prepared as learnt on ``train``."""
    assembler = VectorAssembler(inputCols=[input_name(c) for c in cols], outputCol="features")
    prepared = assembler.transform(preprocessing(train, cols).transform(df))
    return prepared.drop(*[input_name(c) for c in cols])


def fit(train: DataFrame, cols: Sequence[str], kind: str, label: str = "is_delayed", **params: Any) -> PipelineModel:
    """Fit preprocessing and a classifier: ``logistic``, ``forest`` or ``boosted``.

    Logistic regression and forests weigh both classes alike; boosting weighs
    positives by negatives / positives. Rows without a label are left out. The
    training table is read several times, so pass a stored one.

    In each round every task sends its statistics of all nodes or columns, however many rows it has.
    So a table in many files is read by few tasks: one for each core, fewer if it is small.
    """
    spark = train.sparkSession
    shared_folder(spark)
    labelled = train.filter(F.col(label).isNotNull())
    tasks = min(-(-labelled.count() // TASK_ROWS), spark.sparkContext.defaultParallelism)
    labelled = labelled.coalesce(max(1, tasks))
    stage = preprocessing(labelled, cols)
    settings = {**_DEFAULTS[kind], **params}

    if kind == "boosted":
        ratio = pos_weight(labelled, label).first()["scale_pos_weight"]
        weights = {0: 1.0, 1: 1.0 if ratio is None else float(ratio)}
    else:
        found = class_weights(labelled, label).collect()
        weights = {r[label]: r["weight"] for r in found}
        if kind == "logistic":
            # A unit penalty against the weighted sum of losses, which Spark divides by the number of rows.
            settings.setdefault("regParam", 1.0 / max(sum(r["n"] for r in found), 1))
    weight = F.lit(1.0)
    for value, w in weights.items():
        weight = F.when(F.col(label) == value, F.lit(float(w))).otherwise(weight)

    assembler = VectorAssembler(inputCols=[input_name(c) for c in cols], outputCol="features")
    classifier = _CLASSES[kind](featuresCol="features", labelCol=label, weightCol=WEIGHT, **settings)
    needed = labelled.select(*cols, F.col(label).cast("double").alias(label), weight.alias(WEIGHT))
    return Pipeline(stages=[stage, assembler, classifier]).fit(needed)


def score(model: PipelineModel, df: DataFrame, output: str = "delay_probability") -> DataFrame:
    """Adds the probability of class 1; all other model columns are dropped."""
    scored = model.transform(df).withColumn(output, vector_to_array("probability")[1])
    return scored.select(*df.columns, output)


def importance(model: PipelineModel, cols: Sequence[str], n: int | None = 20, spark=None) -> DataFrame:
    """Features by falling importance; there are as many rows as model inputs."""
    spark = spark or _session()
    values = model.stages[-1].featureImportances.toArray()
    rows = [(c, float(v)) for c, v in zip(cols, values, strict=True)]
    table = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return table if n is None else table.limit(n)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def artefact_path(base: str, kind: str, **made_from: Any) -> str:
    """A folder for a model below ``base``, named after its kind and what it was made from.

    Models of other inputs, columns or settings have other folders, so none overwrites another.
    """
    told = json.dumps([kind, made_from], sort_keys=True, default=str)
    return f"{base.rstrip('/')}/{kind}-{hashlib.sha256(told.encode()).hexdigest()[:32]}"


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)

