"""Registered queries: every operator applied to the trips derived from the test tables.

Dates and times leave as text, and results of floating-point sums are rounded to six
digits, so that engines with another order of summation agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import (
    CATEGORICAL,
    DELAY_CAUSES,
    FEATURES_V2,
    MODEL_FEATURES_V1,
    MODEL_FEATURES_V2,
    PREDICTIONS,
    SWEEP_BOOSTED,
    SWEEP_FINAL,
    SWEEP_FOREST_V1,
    TEST_TABLES,
    check_contract,
)
from ..functions import weekend_flag
from ..operators import evaluate, history, models, prepare, quality, report, silver, split, stats
from ..operators.history import ALL_ENTITIES, DAY_ENTITIES, Context, Entity
from ..plans import features
from ..session import materialize as stored_table
from ..session import shared_folder
from ..sources import event_trips, identity, read_table, table_shapes, trips

# Stage tables may have as many rows as the trips.
materialize = partial(stored_table, large=True)

P = TEST_TABLES
Query = Callable[[SparkSession, str], DataFrame]
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
# Rows of the registered exact sample. Models are fitted on all training rows.
LABELLED_ROWS = 4_000
HASH_KEYS = ["fl_date", "op_unique_carrier", "origin", "dest", "crs_dep_time", "distance"]
STATUS_COLUMNS = ["fl_date", "op_unique_carrier", "origin", "dest", "cancelled", "diverted"]
TOP_COLUMNS = ["fl_date", "op_unique_carrier", "origin", "dest", "dep_delay", "arr_delay", "cancelled", "diverted"]

_REGISTRY: dict[str, Query] = {}


def _register(name: str, round_to_6: Sequence[str] = ()) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain(query(spark, sf_dir), round_to_6)

        run.__name__ = name
        run.__doc__ = query.__doc__
        _REGISTRY[name] = run
        return query

    return add


def _plain(df: DataFrame, rounded: Sequence[str]) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            column = column.cast("string")
        elif field.name in rounded:
            column = F.round(column, 6)
        columns.append(column.alias(field.name))
    return df.select(*columns)


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str, str]:
    """Session, input and name of something kept; files that change make it another input."""
    return (spark.sparkContext.applicationId, identity(spark, sf_dir), name)


def _stored(spark: SparkSession, sf_dir: str, name: str, build: Query) -> DataFrame:
    """A stage table, built and written once per session by the tasks that the build ends in; later stages read it."""
    key = _key(spark, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = materialize(build(spark, sf_dir), name)
    return _STORED[key]


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "trips", trips)


def _build_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.silver(check_contract(trips(spark, sf_dir)), P.delay_minutes)


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "silver", _build_silver)


def _completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.completed(_silver(spark, sf_dir))


TRIP = ["fl_date", "op_unique_carrier", "origin", "route", *history.TIME, "is_delayed"]


def _history_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed trips with what histories depend on: of the silver table if it is stored, else cleaned and stored so narrow."""
    if _key(spark, sf_dir, "silver") in _STORED:
        return _completed(spark, sf_dir).select(*TRIP)
    return _stored(spark, sf_dir, "history_trips", lambda *source: silver.completed(_build_silver(*source)).select(*TRIP))


def _with_history(spark: SparkSession, sf_dir: str, entities: Sequence[Entity], keep: Sequence[str] = ()) -> DataFrame:
    """Completed trips with their history, with the columns that it depends on and those to keep, and no others."""
    used = {c for e in entities for c in (e.key, *(history.TIME if e.contexts else ()))}
    kept = [c for c in TRIP if c in used or c in ("fl_date", "is_delayed", *keep)]
    return history.attach_history(_history_trips(spark, sf_dir).select(*kept), entities)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.temporal_split(_completed(spark, sf_dir), P.train_end, P.validation_end)


def _build_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test trips scored by the reliable delay rate of their origin and hour, else the rate of all training trips."""
    done = _completed(spark, sf_dir)
    origin_hour = (Entity("origin", "origin", None, (Context("origin_hour", "scheduled_dep_hour"),)),)
    needed = done.select(*[c for c in done.columns if c in PREDICTIONS], "scheduled_dep_minute", "day_of_week")
    table = features.reliable(history.attach_history(needed, origin_hour), origin_hour, P.reliable_min)
    overall = done.filter(F.col("fl_date") < F.lit(P.train_end)).agg(F.avg("is_delayed")).scalar()
    scored = table.filter(F.col("fl_date") >= F.lit(P.validation_end)).withColumn(
        "delay_probability", F.coalesce("reliable_origin_hour_delay_rate", overall)
    )
    return report.predictions(scored, threshold=P.threshold, edges=P.risk_edges)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "predictions", _build_predictions)


# Tables and columns ---------------------------------------------------------

_register("trips")(trips)


@_register("table_shapes")
def _(spark, sf_dir):
    return table_shapes({name: read_table(spark, sf_dir, name) for name in TABLES})


@_register("flight_status")
def _(spark, sf_dir):
    return silver.flight_status(trips(spark, sf_dir)).select(*STATUS_COLUMNS, "flight_status")


@_register("dep_time_decode")
def _(spark, sf_dir):
    return silver.decode_hhmm(trips(spark, sf_dir)).select("crs_dep_time", "scheduled_dep_hour", "scheduled_dep_minute")


@_register("dep_time_clean")
def _(spark, sf_dir):
    return silver.clean_midnight(trips(spark, sf_dir)).select(
        "crs_dep_time", "crs_dep_time_clean", "scheduled_dep_hour", "scheduled_dep_minute"
    )


@_register("delay_label")
def _(spark, sf_dir):
    return silver.delay_label(trips(spark, sf_dir)).select("fl_date", "origin", "dest", "arr_delay", "is_delayed")


@_register("route_key")
def _(spark, sf_dir):
    return silver.route_key(trips(spark, sf_dir)).select("origin", "dest", "route")


@_register("departure_period")
def _(spark, sf_dir):
    return _silver(spark, sf_dir).select("crs_dep_time", "scheduled_dep_hour", "departure_period")


@_register("is_weekend")
def _(spark, sf_dir):
    day = F.col("day_of_week")
    return _completed(spark, sf_dir).select(
        "fl_date", "day_of_week", weekend_flag(day).alias("is_weekend"), weekend_flag(day, (1, 7)).alias("is_day_1_or_7")
    )


CYCLES = ["dep_hour_sin", "dep_hour_cos", "month_sin", "month_cos"]


@_register("cyclical", CYCLES)
def _(spark, sf_dir):
    return features.calendar(_completed(spark, sf_dir)).select("scheduled_dep_hour", "month", *CYCLES)


@_register("context_keys")
def _(spark, sf_dir):
    keys = ["origin_hour_key", "route_hour_key", "carrier_hour_key", "origin_dow_key", "route_dow_key"]
    return history.context_keys(_completed(spark, sf_dir)).select("fl_date", *keys)


@_register("event_time")
def _(spark, sf_dir):
    return history.event_time(_completed(spark, sf_dir)).select(
        "fl_date", "scheduled_dep_hour", "scheduled_dep_minute", "scheduled_dep_minutes", "flight_datetime_order", "flight_timestamp"
    )


# Filters and previews -------------------------------------------------------


@_register("silver")
def _(spark, sf_dir):
    return _build_silver(spark, sf_dir)


@_register("completed")
def _(spark, sf_dir):
    return _completed(spark, sf_dir)


@_register("cancelled_sample")
def _(spark, sf_dir):
    cols = ["fl_date", "op_unique_carrier", "origin", "dest", "cancellation_code", "diverted"]
    return quality.preview(trips(spark, sf_dir).filter("cancelled = 1"), cols, ["fl_date"], 20)


CLOCK = ["crs_dep_time", "scheduled_dep_hour", "scheduled_dep_minute"]


@_register("invalid_time_raw")
def _(spark, sf_dir):
    return quality.invalid_time(trips(spark, sf_dir)).select(*CLOCK)


@_register("invalid_time_clean")
def _(spark, sf_dir):
    return quality.invalid_time(trips(spark, sf_dir), cleaned=True).select(*CLOCK, "crs_dep_time_clean")


@_register("midnight_audit")
def _(spark, sf_dir):
    return quality.midnight_audit(trips(spark, sf_dir))


@_register("bad_distance")
def _(spark, sf_dir):
    return quality.bad_distance(trips(spark, sf_dir)).select("origin", "dest", "distance")


@_register("bad_flags")
def _(spark, sf_dir):
    return quality.bad_flags(trips(spark, sf_dir)).select("cancelled", "diverted")


@_register("conflicting_flags")
def _(spark, sf_dir):
    return quality.conflicting_flags(trips(spark, sf_dir)).select(*STATUS_COLUMNS)


@_register("violations")
def _(spark, sf_dir):
    return quality.violations(trips(spark, sf_dir))


@_register("violations_odd")
def _(spark, sf_dir):
    """The same counts over trips some of which break each of the rules."""
    kind, distance = F.col("distance") % 17, F.col("distance")
    none = F.lit(None)
    odd = {
        "distance": F.when(distance % 11 == 0, 0).when(distance % 11 == 1, -distance).otherwise(distance),
        "cancelled": F.when(kind == 0, 2).when(kind == 1, none).when(kind == 2, 1).otherwise(F.col("cancelled")),
        "diverted": F.when(kind == 2, 1).when(kind == 3, -1).otherwise(F.col("diverted")),
        "crs_dep_time": F.when(distance % 13 == 0, none).when(distance % 13 == 1, -1).when(distance % 13 == 2, 2360).otherwise(F.col("crs_dep_time")),
    }
    return quality.violations(trips(spark, sf_dir).withColumns({c: x.cast("int") for c, x in odd.items()}))


@_register("feature_preview")
def _(spark, sf_dir):
    table = _with_history(spark, sf_dir, DAY_ENTITIES)
    table = table.filter(F.col("fl_date") >= F.lit(P.preview_from))
    cols = ["fl_date", "route", *DAY_ENTITIES[0].columns[:2], *DAY_ENTITIES[1].columns[:2], *DAY_ENTITIES[2].columns[:2], "is_delayed"]
    return quality.preview(table, cols, ["fl_date"], 30)


@_register("history_for_key")
def _(spark, sf_dir):
    entity = Entity("origin", "origin", None, (Context("origin_hour", "scheduled_dep_hour", 7),))
    values = {"origin": "NATION_12", "scheduled_dep_hour": 12}
    table = history.history_for_key(_completed(spark, sf_dir).select(*TRIP), entity, values)
    return table.select("fl_date", "origin", "scheduled_dep_hour", "scheduled_dep_minute", "is_delayed", *entity.contexts[0].columns)


@_register("temporal_split")
def _(spark, sf_dir):
    counts = _split(spark, sf_dir).groupBy("part")
    return counts.agg(F.count("*").alias("flights"), F.min("fl_date").alias("first_day"), F.max("fl_date").alias("last_day"))


@_register("preview")
def _(spark, sf_dir):
    cols = ["fl_date", "op_unique_carrier", "origin", "dest", *CLOCK, "flight_status", "arr_delay", "is_delayed"]
    return quality.preview(_silver(spark, sf_dir), cols, ["fl_date"], 20)


@_register("top_delays")
def _(spark, sf_dir):
    return stats.top_rows(_silver(spark, sf_dir), "arr_delay", TOP_COLUMNS, 20)


# Quality profiles -----------------------------------------------------------


@_register("null_counts")
def _(spark, sf_dir):
    return quality.null_counts(trips(spark, sf_dir))


@_register("duplicate_groups")
def _(spark, sf_dir):
    return quality.duplicate_groups(_trips(spark, sf_dir))


SUMMARY = ["mean", "stddev", "p25", "p50", "p75"]


@_register("summary_delay", SUMMARY)
def _(spark, sf_dir):
    return quality.summary(_trips(spark, sf_dir), ["dep_delay", "arr_delay", "cancelled", "diverted"])


@_register("summary_ops", SUMMARY)
def _(spark, sf_dir):
    cols = ["dep_delay", "arr_delay", "taxi_out", "taxi_in", "air_time", "distance"]
    return quality.summary(_completed(spark, sf_dir), cols)


def _value_counts(name: str, column: str, limit: int | None = None) -> None:
    @_register(f"value_counts_{name}")
    def _(spark, sf_dir):
        return quality.value_counts(_silver(spark, sf_dir), [column], limit)


_value_counts("cancelled", "cancelled")
_value_counts("diverted", "diverted")
_value_counts("carrier", "op_unique_carrier")
_value_counts("origin", "origin", 20)
_value_counts("cancellation_code", "cancellation_code")
_value_counts("status", "flight_status")
_value_counts("period", "departure_period")


@_register("missing_by_status")
def _(spark, sf_dir):
    cols = ["arr_delay", "dep_delay", "actual_elapsed_time", "air_time"]
    return quality.missing_by(trips(spark, sf_dir), ["cancelled", "diverted"], cols)


@_register("pct_status")
def _(spark, sf_dir):
    return quality.pct_of_total(_silver(spark, sf_dir), ["flight_status"])


@_register("pct_label")
def _(spark, sf_dir):
    return quality.pct_of_total(_completed(spark, sf_dir), ["is_delayed"])


@_register("pct_label_by_split")
def _(spark, sf_dir):
    return quality.pct_of_total(_split(spark, sf_dir), ["is_delayed"], within=["part"])


@_register("pct_history")
def _(spark, sf_dir):
    table = features.has_history(_with_history(spark, sf_dir, DAY_ENTITIES[:1]), DAY_ENTITIES[:1])
    return quality.pct_of_total(table, ["has_route_history"])


@_register("history_range")
def _(spark, sf_dir):
    table = _with_history(spark, sf_dir, DAY_ENTITIES)
    return quality.value_range(table, [e.columns[0] for e in DAY_ENTITIES])


@_register("unreliable_counts")
def _(spark, sf_dir):
    table = features.reliable(_with_history(spark, sf_dir, DAY_ENTITIES), DAY_ENTITIES, P.reliable_min)
    return quality.unreliable_counts(table, [f"reliable_{e.name}_delay_rate" for e in DAY_ENTITIES])


@_register("weekend_distinct")
def _(spark, sf_dir):
    return features.calendar(_completed(spark, sf_dir)).select("fl_date", "day_of_week", "is_weekend").distinct()


@_register("feature_nulls")
def _(spark, sf_dir):
    return quality.feature_nulls(_stored_features(spark, sf_dir), MODEL_FEATURES_V2)


@_register("probability_profile", ["value"])
def _(spark, sf_dir):
    return quality.probability_profile(_predictions(spark, sf_dir), "delay_probability")


@_register("label_distribution")
def _(spark, sf_dir):
    return quality.value_shares(_predictions(spark, sf_dir), ["is_delayed", "predicted_delay", "risk_category"])


# Group statistics -----------------------------------------------------------


@_register("carrier_stats")
def carrier_stats(spark, sf_dir):
    return stats.group_stats(_completed(spark, sf_dir), ["op_unique_carrier"], median=True)


@_register("airport_stats")
def _(spark, sf_dir):
    keys = ["origin", "origin_city_name", "origin_state_nm"]
    return stats.group_stats(_completed(spark, sf_dir), keys, "dep_delay", min_rows=P.airport_min, top=20)


@_register("period_stats")
def _(spark, sf_dir):
    return stats.group_stats(_completed(spark, sf_dir), ["departure_period"])


@_register("hour_stats")
def _(spark, sf_dir):
    return stats.group_stats(_completed(spark, sf_dir), ["scheduled_dep_hour"])


@_register("route_stats")
def _(spark, sf_dir):
    return stats.group_stats(_completed(spark, sf_dir), ["route"], min_rows=P.route_min, top=20)


@_register("delay_causes")
def _(spark, sf_dir):
    return stats.cause_totals(_completed(spark, sf_dir), DELAY_CAUSES)


@_register("month_stats")
def _(spark, sf_dir):
    return stats.group_stats(_completed(spark, sf_dir), ["month"])


@_register("distance_stats")
def _(spark, sf_dir):
    return stats.group_stats(stats.distance_bucket(_completed(spark, sf_dir)), ["distance_bucket"])


# History --------------------------------------------------------------------


def _day_queries(entity: Entity) -> None:
    @_register(f"daily_{entity.name}")
    def _(spark, sf_dir):
        return history.daily(_completed(spark, sf_dir), entity.key, entity.name)

    @_register(f"hist_{entity.name}")
    def _(spark, sf_dir):
        table = _with_history(spark, sf_dir, [entity])
        return table.select("fl_date", entity.key, "is_delayed", *entity.columns[:2])

    @_register(f"roll7_{entity.name}")
    def _(spark, sf_dir):
        table = _with_history(spark, sf_dir, [entity])
        return table.select("fl_date", entity.key, "is_delayed", *entity.columns[2:])


def _context_queries(entity: Entity, context: Context) -> None:
    one = Entity(entity.name, entity.key, None, (context,))
    cols = ["fl_date", entity.key, "scheduled_dep_hour", "scheduled_dep_minute", "day_of_week", "is_delayed"]

    @_register(f"ctx_{context.name}")
    def _(spark, sf_dir):
        return _with_history(spark, sf_dir, [one]).select(*cols, *context.columns[:2])

    if context.days:

        @_register(f"ctx7_{context.name}")
        def _(spark, sf_dir):
            return _with_history(spark, sf_dir, [one]).select(*cols, *context.columns[2:])


for _entity in ALL_ENTITIES:
    _day_queries(_entity)
    for _context in _entity.contexts:
        _context_queries(_entity, _context)


@_register("event_history")
def _(spark, sf_dir):
    """Context history of the event stream, whose times are known to the second."""
    events = event_trips(spark, sf_dir)
    table = history.attach_second_history(events, ["origin", "scheduled_dep_hour"], "origin_hour", "flight_timestamp")
    names = ["historical_origin_hour_flights", "historical_origin_hour_delay_rate", "origin_hour_flights_last_7d", "origin_hour_delay_rate_last_7d"]
    return table.select("event_id", "origin", "scheduled_dep_hour", "is_delayed", *names)


KEY_COLUMNS = ["fl_date", "op_unique_carrier", "route", "scheduled_dep_hour", "is_delayed"]


@_register("has_history")
def _(spark, sf_dir):
    table = features.has_history(_with_history(spark, sf_dir, DAY_ENTITIES, KEY_COLUMNS))
    return table.select(*KEY_COLUMNS, *[f"has_{e.name}_history" for e in DAY_ENTITIES])


@_register("reliable_rates_v1")
def _(spark, sf_dir):
    table = features.reliable(_with_history(spark, sf_dir, DAY_ENTITIES, KEY_COLUMNS), DAY_ENTITIES, P.reliable_min)
    return table.select(*KEY_COLUMNS, *[f"reliable_{e.name}_delay_rate" for e in DAY_ENTITIES])


@_register("reliable_rates_v2")
def _(spark, sf_dir):
    entities = history.CONTEXT_ENTITIES
    table = features.reliable(_with_history(spark, sf_dir, entities), entities, P.reliable_min)
    return table.select(*KEY_COLUMNS, *[f"reliable_{c.name}_delay_rate" for e in entities for c in e.contexts])


@_register("features_v1", CYCLES)
def _(spark, sf_dir):
    return features.features_v1(_completed(spark, sf_dir), P.reliable_min)


@_register("features_v2", CYCLES)
def _(spark, sf_dir):
    return features.features_v2(_feature_trips(spark, sf_dir), P.reliable_min)


@_register("odd_time_history")
def _(spark, sf_dir):
    """All histories of trips some of which have no, a negative or a too large departure time."""
    kind = F.col("distance") % 13
    odd = F.when(kind == 0, F.lit(None)).when(kind == 1, -1).when(kind == 2, 2360).otherwise(F.col("crs_dep_time"))
    # Stored as narrow as the histories need them; the wide trips are read only if they are stored anyway.
    source = _trips(spark, sf_dir) if _key(spark, sf_dir, "trips") in _STORED else trips(spark, sf_dir)
    table = silver.completed(silver.silver(source.withColumn("crs_dep_time", odd.cast("int"))))
    columns = [c for e in ALL_ENTITIES for part in e.parts for c in part.columns]
    table = materialize(table.select(*TRIP, "crs_dep_time"), "odd_times")
    return history.attach_history(table, ALL_ENTITIES).select("fl_date", "route", "crs_dep_time", *columns)


# Sampling, encoding, preparation --------------------------------------------


@_register("bernoulli_sample")
def _(spark, sf_dir):
    return split.bernoulli(_completed(spark, sf_dir), n=20_000)


@_register("bernoulli_fraction")
def _(spark, sf_dir):
    return split.bernoulli(split.part_of(_split(spark, sf_dir), "validation"), fraction=0.20)


@_register("exact_sample")
def _(spark, sf_dir):
    """A bounded number of training rows, the same ones on every run."""
    train = split.part_of(_split(spark, sf_dir), "train").select(*HASH_KEYS, "is_delayed")
    return split.exact_sample(train, LABELLED_ROWS)


@_register("hash_sample")
def _(spark, sf_dir):
    return split.hash_sample(_completed(spark, sf_dir), HASH_KEYS, 100).select(*HASH_KEYS, "is_delayed")


@_register("freq_encode")
def _(spark, sf_dir):
    table = split.freq_encode(_split(spark, sf_dir))
    return table.select("fl_date", "part", *CATEGORICAL, *[f"{c}_frequency" for c in CATEGORICAL])


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All inputs of the second model for all trips, and those of the training part."""
    table = _stored_features(spark, sf_dir).select("fl_date", "route", *MODEL_FEATURES_V2)
    return table, table.filter(F.col("fl_date") < F.lit(P.train_end))


@_register("median_impute", MODEL_FEATURES_V2)
def _(spark, sf_dir):
    table, train = _inputs(spark, sf_dir)
    return prepare.impute(table, prepare.fit_medians(train, MODEL_FEATURES_V2))


@_register("imputed_nulls")
def _(spark, sf_dir):
    """Missing and infinite model inputs after imputation."""
    table, train = _inputs(spark, sf_dir)
    return quality.feature_nulls(prepare.impute(table, prepare.fit_medians(train, MODEL_FEATURES_V2)), MODEL_FEATURES_V2)


@_register("standard_scale", MODEL_FEATURES_V2)
def _(spark, sf_dir):
    table, train = _inputs(spark, sf_dir)
    medians = prepare.fit_medians(train, MODEL_FEATURES_V2)
    return prepare.scale(prepare.impute(table, medians), prepare.fit_scale(train, MODEL_FEATURES_V2, medians))


@_register("class_weights")
def _(spark, sf_dir):
    return prepare.class_weights(split.part_of(_split(spark, sf_dir), "train"))


@_register("scale_pos_weight")
def _(spark, sf_dir):
    return prepare.pos_weight(split.part_of(_split(spark, sf_dir), "train"))


# Predictions and metrics ----------------------------------------------------


@_register("predictions")
def _(spark, sf_dir):
    return _build_predictions(spark, sf_dir)


@_register("predicted_label")
def _(spark, sf_dir):
    return _predictions(spark, sf_dir).select("fl_date", "route", "delay_probability", "predicted_delay")


@_register("risk_category")
def _(spark, sf_dir):
    return _predictions(spark, sf_dir).select("fl_date", "route", "delay_probability", "risk_category")


@_register("baseline_metrics")
def _(spark, sf_dir):
    return evaluate.baseline_metrics(split.part_of(_split(spark, sf_dir), "validation"))


@_register("binary_metrics")
def _(spark, sf_dir):
    return evaluate.binary_metrics(_predictions(spark, sf_dir))


@_register("roc_auc", ["roc_auc"])
def _(spark, sf_dir):
    return evaluate.roc_auc(_predictions(spark, sf_dir))


@_register("average_precision", ["average_precision"])
def _(spark, sf_dir):
    return evaluate.average_precision(_predictions(spark, sf_dir))


@_register("confusion_matrix")
def _(spark, sf_dir):
    return evaluate.confusion(_predictions(spark, sf_dir))


@_register("threshold_sweep")
def _(spark, sf_dir):
    return evaluate.threshold_sweep(_predictions(spark, sf_dir), SWEEP_BOOSTED)


@_register("threshold_sweep_first")
def _(spark, sf_dir):
    return evaluate.threshold_sweep(_predictions(spark, sf_dir), SWEEP_FOREST_V1)


@_register("threshold_sweep_final")
def _(spark, sf_dir):
    return evaluate.threshold_sweep(_predictions(spark, sf_dir), SWEEP_FINAL)


@_register("classification_report", ["precision", "recall", "f1"])
def _(spark, sf_dir):
    return evaluate.classification_report(_predictions(spark, sf_dir))


# Reports --------------------------------------------------------------------

RATES = ["avg_risk", "actual_delay_rate", "predicted_delay_rate"]


@_register("airline_risk", RATES)
def _(spark, sf_dir):
    return report.airline_risk(_predictions(spark, sf_dir))


@_register("carrier_ranking")
def _(spark, sf_dir):
    return report.carrier_ranking(_predictions(spark, sf_dir), P.carrier_test_min)


@_register("route_risk", RATES)
def _(spark, sf_dir):
    return report.route_risk(_predictions(spark, sf_dir), P.route_test_min, top=20)


@_register("hour_risk", RATES)
def _(spark, sf_dir):
    return report.hour_risk(_predictions(spark, sf_dir))


@_register("risk_table", RATES)
def _(spark, sf_dir):
    return report.risk_table(_predictions(spark, sf_dir))


@_register("daily_trend", RATES)
def _(spark, sf_dir):
    return report.daily_trend(_predictions(spark, sf_dir))


@_register("high_risk_coverage")
def _(spark, sf_dir):
    return report.coverage(_predictions(spark, sf_dir))


@_register("error_types")
def _(spark, sf_dir):
    return report.error_types(_predictions(spark, sf_dir))


@_register("carrier_model_quality", RATES)
def _(spark, sf_dir):
    return report.quality_by(_predictions(spark, sf_dir), ["op_unique_carrier"], P.carrier_test_min)


@_register("model_kpis", ["value"])
def _(spark, sf_dir):
    return report.model_kpis(_predictions(spark, sf_dir))


# Models ---------------------------------------------------------------------


def _feature_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed trips with what the second feature table takes over: of the silver table if it is stored, else stored so narrow."""
    if _key(spark, sf_dir, "silver") in _STORED:
        return features.needed_v2(_completed(spark, sf_dir))
    return _stored(spark, sf_dir, "feature_trips", lambda *source: features.needed_v2(silver.completed(_build_silver(*source))))


def _build_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.histories_v2(_feature_trips(spark, sf_dir))


def _stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second feature table with its split; what follows from other columns of a row is not stored."""
    stored = _stored(spark, sf_dir, "histories", lambda *source: features.with_late(_build_histories(*source)))
    return _derived(features.with_rates(stored))


def _derived(histories: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return split.temporal_split(features.from_histories_v2(histories, P.reliable_min, keep), P.train_end, P.validation_end)


def _model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second feature table for work on a sample: all rows but the training rows that the sample does not take.

    No registered query reads it, as their models are fitted on all training rows.

    Histories are those of all trips, and the sample is the one of all training rows: it consists of the rows with the
    smallest digests, and all rows up to a digest are stored. If too few are, since equal rows have one digest, or
    if the whole table is stored already, that is read.
    """
    key = _key(spark, sf_dir, "model_histories")
    if key not in _STORED:
        if _key(spark, sf_dir, "histories") in _STORED:
            return _stored_features(spark, sf_dir)
        trips = split.temporal_split(_feature_trips(spark, sf_dir), P.train_end, P.validation_end)
        rows = split.part_of(trips, "train").count()
        groups = split.sample_reach(rows, LABELLED_ROWS)
        histories = _build_histories(spark, sf_dir)
        table = _derived(histories, histories.columns)
        taken = (F.col("part") != "train") | split.in_reach(table, groups, FEATURES_V2)
        table = materialize(table.filter(taken).select(*histories.columns), "model_histories")
        if split.part_of(_derived(table), "train").count() < min(rows, LABELLED_ROWS):
            return _stored_features(spark, sf_dir)
        _STORED[key] = table
    return _derived(_STORED[key])


SCORED = ["fl_date", "op_unique_carrier", "origin", "dest", "route", "scheduled_dep_hour", "is_delayed", "delay_probability"]
_MODELS: dict[tuple[str, str, str], PipelineModel] = {}


def _model_inputs(spark: SparkSession, sf_dir: str, first: bool) -> DataFrame:
    """All rows of the feature table that models are fitted on and score, with the frequency columns of the first ones."""
    if not first:
        return _stored_features(spark, sf_dir)
    key = _key(spark, sf_dir, "first_inputs")
    if key not in _STORED:
        _STORED[key] = split.freq_encode(_stored_features(spark, sf_dir))
    return _STORED[key]


def _model(spark: SparkSession, sf_dir: str, kind: str, first: bool = False) -> PipelineModel:
    """A model at its documented settings, fitted once per session on all training rows.

    ``first`` chooses the inputs and settings of the first models.
    """
    key = _key(spark, sf_dir, f"{kind}{1 if first else 2}")
    if key not in _MODELS:
        train = split.part_of(_model_inputs(spark, sf_dir, first), "train")
        settings = {"logistic": models.LOGISTIC_V1, "forest": models.FOREST_V1, "boosted": models.BOOSTED_V1}
        chosen = settings[kind] if first else models.FINAL[kind]
        _MODELS[key] = models.fit(train, MODEL_FEATURES_V1 if first else MODEL_FEATURES_V2, kind, **chosen)
    return _MODELS[key]


@_register("feature_vector")
def _(spark, sf_dir):
    stored = _model_inputs(spark, sf_dir, first=True)
    train = stored.filter(F.col("part") == "train")
    table = models.feature_vector(train, stored, MODEL_FEATURES_V1)
    return table.select("fl_date", "route", "part", vector_to_array("features").alias("features"))


def _scores(kind: str, first: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = _model_inputs(spark, sf_dir, first)
        return models.score(_model(spark, sf_dir, kind, first), split.part_of(table, "validation")).select(*SCORED)

    return run


for _name, _kind in (("lr", "logistic"), ("rf", "forest"), ("gbt", "boosted")):
    _register(f"{_name}_scores")(_scores(_kind))
    _register(f"{_name}_v1_scores")(_scores(_kind, first=True))


@_register("score_test")
def _(spark, sf_dir):
    test = split.part_of(_stored_features(spark, sf_dir), "test")
    scored = models.score(_model(spark, sf_dir, "forest"), test)
    return report.predictions(scored, threshold=P.threshold, edges=P.risk_edges)


@_register("feature_importance")
def _(spark, sf_dir):
    return models.importance(_model(spark, sf_dir, "forest"), MODEL_FEATURES_V2, 20, spark)


@_register("model_roundtrip")
def _(spark, sf_dir):
    """Test scores of a model that was saved and loaded again, beside those of the original."""
    test = split.part_of(_stored_features(spark, sf_dir), "test")
    model = _model(spark, sf_dir, "forest")
    base = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/models"
    made_from = {"input": identity(spark, sf_dir), "columns": MODEL_FEATURES_V2}
    path = models.artefact_path(base, "forest", **made_from, **models.FINAL["forest"])
    models.save(model, path)
    both = models.score(models.load(path), models.score(model, test, "original"), "reloaded")
    return both.select("fl_date", "route", "original", "reloaded")


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: delay statistics per carrier."""
    return _REGISTRY["carrier_stats"](spark, sf_dir)
