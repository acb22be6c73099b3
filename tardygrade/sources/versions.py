"""Tables that are replaced as a whole, or not at all.

Every version of a table lies in a folder of its own below the table's path, and is written
there by Spark while readers see the version before. Once the data are complete, an empty
marker is created whose name holds a number and the folder: the greatest one names the
current version. Creating a file is one step on every store, so readers see the old rows or
the new ones, and a write that fails, or whose driver is lost, changes nothing. Of two writers
at a time both succeed, and the later number, or of equal numbers the greater name, counts.

The version before stays, for queries that have begun to read it; older ones are deleted, as
are plain files of a table that was written without versions. A path without markers is
read as it is. A folder that a lost driver leaves behind has no marker and is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MARKERS = "_versions"
DATA = "data-"


def _at(spark: SparkSession, path: str):
    """File system and path object."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    files, place = _at(spark, path)
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete versions of a table, oldest first."""
    return sorted(_names(spark, f"{path}/{MARKERS}"))


def current_path(spark: SparkSession, path: str) -> str:
    """The folder that holds the current rows of the table at ``path``."""
    found = versions(spark, path)
    return f"{path}/{_folder(found[-1])}" if found else path


def _folder(marker: str) -> str:
    return DATA + marker.split("-", 1)[1]


def replace(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 2) -> None:
    """Let ``write`` fill a new folder, make it the table at ``path``, and delete all but ``keep`` versions."""
    key = uuid.uuid4().hex
    folder = f"{path}/{DATA}{key}"
    try:
        write(folder)
    except BaseException:
        _delete(spark, folder)
        raise
    before = versions(spark, path)
    number = int(before[-1].split("-", 1)[0]) + 1 if before else 1
    files, marker = _at(spark, f"{path}/{MARKERS}/{number:012d}-{key}")
    files.create(marker, False).close()

    old = versions(spark, path)[: -max(keep, 1)]
    # Markers go first, so no marker ever names a folder that is gone.
    for name in old:
        _delete(spark, f"{path}/{MARKERS}/{name}")
    for name in old:
        _delete(spark, f"{path}/{_folder(name)}")
    for name in _names(spark, path):
        if name != MARKERS and not name.startswith(DATA):
            _delete(spark, f"{path}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)


def identity(spark: SparkSession, path: str) -> str:
    """Name, time, bytes and number of files of each table in a folder; it changes when a table there does.

    Files are summed up by the store, so the work here is that of a few tables, however many files they have.
    """
    files, place = _at(spark, path)
    found = []
    for status in files.listStatus(place):
        size = files.getContentSummary(status.getPath())
        found.append(f"{status.getPath()} {status.getModificationTime()} {size.getLength()} {size.getFileCount()}")
    return "\n".join(sorted(found))
