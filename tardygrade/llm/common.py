"""Helpers that the text operators share."""

from __future__ import annotations

import binascii
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

__all__ = ["binaries", "crc_fold", "fresh", "materialize", "read", "strings", "texts"]

# Rows in one Arrow batch: a few hundred texts keep a task's batch at some megabytes,
# and a batch of very long texts far below its memory.
BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_fold(key: str | Column, folds: int) -> Column:
    """The fold of a row by the CRC-32 of its key as text; null keys have no fold."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % folds


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts(array: pa.Array) -> list[str]:
    """The texts of an Arrow array, null as the empty text."""
    return [value or "" for value in array.to_pylist()]


def binaries(values: Iterable[bytes]) -> pa.Array:
    return pa.array(list(values), pa.binary())


def strings(values: Iterable[str | None]) -> pa.Array:
    return pa.array(list(values), pa.string())


def pieces(batch: pa.RecordBatch, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that what is built from one slice stays small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def fold_of(key: object, folds: int) -> int:
    """``crc_fold`` for one key, for tests and small samples."""
    return binascii.crc32(str(key).encode()) % folds


def int_lists(flat: np.ndarray, sizes: Iterable[int], kind: pa.DataType | None = None) -> pa.Array:
    """A list array from the concatenated values and the size of each list."""
    offsets = np.zeros(len(sizes := list(sizes)) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind) if kind else pa.array(flat))
