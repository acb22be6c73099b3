"""Trip tables derived from the star-schema and event test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import epoch_seconds
from .tables import read_table

# The columns that trips are made of.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_nationkey INT",
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "part": "p_partkey BIGINT, p_brand STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name, SCHEMAS[name])


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip per order line, with every column of the source contract.

    All joins are inner equi-joins on the keys of the other side, with narrow column
    lists. Orders meet their customers first, so that order lines are shuffled once
    for both, and suppliers, the shortest of the long lists, come first. Nations and
    regions are fixed lists of a few rows; whether they and the
    other sides are broadcast is left to the optimizer, which knows the file sizes,
    and adaptive execution splits hot keys of the joins that shuffle.
    """
    region = _read(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("origin_state_nm"))
    nation = _read(spark, sf_dir, "nation")
    here = nation.select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("origin"), F.col("n_regionkey").alias("r_regionkey")
    )
    there = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dest"))
    supplier = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    customer = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = (
        _read(spark, sf_dir, "orders")
        .select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        .join(customer, "o_custkey")
        .select("l_orderkey", "c_nationkey")
    )
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    # What the shuffles carry: no timestamp, no price, and of each key that is not needed any more its remainder.
    lines = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.col("l_shipdate").cast("date").alias("fl_date"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.floor(F.col("l_extendedprice") / 40).cast("int").alias("distance"),
        F.expr("int(l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1)").alias("cancelled"),
        F.expr("int(l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 7)").alias("diverted"),
    )
    lines = (
        lines.join(supplier, "l_suppkey")
        .withColumn("of_supplier", (F.col("l_suppkey") % 24).cast("int"))
        .drop("l_suppkey")
        .join(part, "l_partkey")
        .withColumn("of_part", (F.col("l_partkey") % 100).cast("int"))
        .drop("l_partkey")
        .join(orders, "l_orderkey")
        .withColumn("minute", (F.col("l_orderkey") % 60).cast("int"))
        .join(here, "s_nationkey")
        .join(region, "r_regionkey")
        .join(there, "c_nationkey")
    )

    slot = F.col("of_part") % 25
    lag = F.col("of_supplier") % 8
    line = F.col("line")
    off = F.col("cancelled") == 1
    astray = F.col("diverted") == 1
    late = F.col("arr_delay") >= 15

    def cause(residue: int | None):
        share = F.lit(0) if residue is None else F.when(F.col("of_supplier") % 3 == residue, F.col("arr_delay")).otherwise(0)
        return F.when(late, share)

    return (
        lines.withColumn("crs_dep_time", F.when(slot == 24, 2400).otherwise(slot * 100 + F.col("minute")))
        .withColumn("arr_delay", F.when(~off & ~astray, F.col("quantity") - 35 + slot % 24))
        .select(
            "fl_date",
            F.month("fl_date").alias("month"),
            (F.weekday("fl_date") + 1).alias("day_of_week"),
            F.col("p_brand").alias("op_unique_carrier"),
            "origin",
            F.col("origin").alias("origin_city_name"),
            "origin_state_nm",
            "dest",
            "crs_dep_time",
            F.when(~off, F.coalesce("arr_delay", F.lit(0)) - line + 3).alias("dep_delay"),
            "arr_delay",
            F.when(~off, line + 10).alias("taxi_out"),
            F.when(~off, lag + 3).alias("taxi_in"),
            F.when(~off & ~astray, (F.floor(F.col("distance") / 8) + 20).cast("int")).alias("air_time"),
            F.when(~off & ~astray, (F.floor(F.col("distance") / 8) + 33 + line + lag).cast("int")).alias(
                "actual_elapsed_time"
            ),
            "distance",
            "cancelled",
            "diverted",
            F.when(off, F.substring(F.lit("ABCD"), F.col("of_part") % 4 + 1, F.lit(1))).alias(
                "cancellation_code"
            ),
            cause(0).alias("carrier_delay"),
            cause(1).alias("weather_delay"),
            cause(2).alias("nas_delay"),
            cause(None).alias("security_delay"),
            cause(None).alias("late_aircraft_delay"),
        )
    )


def event_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as trips whose time is known to the second."""
    day, hour, minute = F.col("ts").cast("date"), F.hour("ts"), F.minute("ts")
    return _read(spark, sf_dir, "events").select(
        "event_id",
        day.alias("fl_date"),
        hour.alias("scheduled_dep_hour"),
        minute.alias("scheduled_dep_minute"),
        F.col("event_type").alias("op_unique_carrier"),
        (F.col("user_id") % 25).alias("origin"),
        (F.col("value") >= 70).cast("int").alias("is_delayed"),
        (epoch_seconds(day, hour, minute) + F.second("ts")).alias("flight_timestamp"),
    )
