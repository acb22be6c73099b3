"""Parquet tables under a base path, catalog tables, and small JSON artefacts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .versions import current_path, replace

MONTH_PARTITION = "part_month"


def table_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, base: str, name: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The current version of a named table under ``base``, without the month column that only lays out its files.

    A given schema saves the job that would read it from a file footer.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(current_path(spark, table_path(base, name))).drop(MONTH_PARTITION)


def read_between(
    spark: SparkSession, base: str, name: str, since: date | None = None, until: date | None = None,
    date_col: str = "fl_date",
) -> DataFrame:
    """Rows with ``since <= date_col < until`` of a table written by month.

    The bounds are also put on the month folders, so that other months are not read.
    """
    df = spark.read.parquet(current_path(spark, table_path(base, name)))
    month = F.col(MONTH_PARTITION)
    if since is not None:
        df = df.filter((F.col(date_col) >= F.lit(since)) & (month >= since.year * 100 + since.month))
    if until is not None:
        df = df.filter((F.col(date_col) < F.lit(until)) & (month <= until.year * 100 + until.month))
    return df.drop(MONTH_PARTITION)


def write_table(df: DataFrame, base: str, name: str, month_of: str | None = None) -> str:
    """Replace a named table, its schema included, and return its path.

    Until the new rows are complete the old ones stay, so a table may also be computed from
    itself, and a write that fails changes nothing; see ``versions``.

    With ``month_of`` the files are laid out by the month of that date column. The
    rebalance step lets adaptive execution split a large month over several tasks
    and merge small ones, so neither a hot month nor many tiny files arise.
    """
    path = table_path(base, name)

    def write(folder: str) -> None:
        if month_of is None:
            df.write.parquet(folder)
        else:
            month = (F.year(month_of) * 100 + F.month(month_of)).alias(MONTH_PARTITION)
            laid_out = df.select("*", month).hint("rebalance", MONTH_PARTITION)
            laid_out.write.partitionBy(MONTH_PARTITION).parquet(folder)

    replace(df.sparkSession, path, write)
    return path


def write_catalog_table(df: DataFrame, name: str) -> None:
    """Overwrite a table of the current catalog, its schema included."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def table_profile(spark: SparkSession, path: str) -> DataFrame:
    """Format, number of files, bytes and rows of a Parquet table, of its current version.

    Files are listed without reading them; rows come from the Parquet footers.
    """
    path = current_path(spark, path)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
    )
    rows = spark.read.parquet(path).agg(F.count("*").alias("n_rows"))
    return files.select(F.lit("parquet").alias("format"), "n_files", "n_bytes", rows.scalar().alias("n_rows"))


def table_shapes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of several tables, counted in one plan."""
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def rows_frame(spark: SparkSession, rows: Iterable[Sequence[Any]], schema: str | T.StructType) -> DataFrame:
    """A DataFrame of a few literal rows."""
    return spark.createDataFrame(list(rows), schema)


def save_json(spark: SparkSession, values: Mapping[str, Any] | Sequence[str], path: str) -> None:
    """Write a feature list or a metrics map as one JSON line on the table storage."""
    body = dict(values) if isinstance(values, Mapping) else {"values": list(values)}
    fields = []
    for key, value in body.items():
        kind = T.ArrayType(T.StringType()) if isinstance(value, list) else T.DoubleType()
        fields.append(T.StructField(key, kind))
        if not isinstance(value, list):
            body[key] = None if value is None else float(value)
    frame = spark.createDataFrame([tuple(body.values())], T.StructType(fields))
    frame.coalesce(1).write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str) -> dict[str, Any] | list[str]:
    """Read back what ``save_json`` wrote."""
    body = spark.read.json(path).first().asDict()
    return body["values"] if list(body) == ["values"] else body
