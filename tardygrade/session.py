"""Spark session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows of a file of an intermediate table, at most.
FILE_ROWS = 1 << 18
# Whether the shuffles of a query are deleted when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session_conf(shuffle_bytes: int | None = None, cores: int = 8) -> dict[str, str]:
    """SQL settings for a run that shuffles about ``shuffle_bytes`` per stage.

    Shuffles start with partitions of about 128 MB; adaptive execution merges
    small ones and splits skewed ones, so the figure need only be roughly right.
    """
    partitions = cores if shuffle_bytes is None else max(cores, -(-shuffle_bytes // (128 << 20)))
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A measured build side below this is hashed instead of sorting both sides.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(128 << 20),
        "spark.sql.shuffle.partitions": str(partitions),
    }


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "tardygrade") -> SparkSession:
    """A ``local[cores]`` session for tests and benchmarks."""
    n = cores if isinstance(cores, int) or cores.isdigit() else 8
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in session_conf(cores=int(n)).items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only in local mode, where that is unset, a temporary folder that goes when Python ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tardygrade-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What queries that begin here have shuffled is deleted as soon as they end, not when the driver collects garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def materialize(df: DataFrame, label: str = "table", large: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the written table.

    This cuts the lineage in a way that survives the loss of executors. The scan
    is columnar, and its size is known to the optimizer, so that later joins
    broadcast it only if it is really small. Files have a bounded number of rows, so that
    a table that few tasks wrote is read by more. A ``large`` table is compressed more, and what was
    shuffled for it goes once it is written, so that the disk holds one stage at a time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("maxRecordsPerFile", FILE_ROWS)
    if large:
        with _shuffles_dropped(spark):
            writer.parquet(path, compression="zstd")
    else:
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
