"""Web archives: written with one gzip member per record, read in parallel by byte ranges.

Writing. Every row becomes a WARC record. Of rows with equal payloads of at least
``least_bytes`` bytes, the one with the largest id is a response and the others are revisits
of it, which keep its HTTP header and refer to it. Archives are written by Spark's text
writer, so they can lie in any store and only files of finished tasks are seen. That writer
ends every row with a separator; a gzip member ends with the upper byte of its length, which
is 0 below 16 MB, so the separator is this 0. A longer record is followed by an empty member.

Reading. Archives are listed and cut into byte ranges, which are dealt to tasks. A task looks
for the gzip magic in its range, decodes the beginning of each candidate and accepts it if a
WARC header comes out; it owns the records that start inside and reads past its range to
finish the last one. After an accepted member it goes on at the member's end, where the next
one must begin, in this range or in the next. A member that is damaged or cut off raises, and
so do bytes outside the members, so no record is lost without an error.

Results. A null payload is empty. Rows with a null id never become the response of others,
unless all ids of a payload are null; of rows that share the largest id all are responses.
Digests and lengths are those of the full payload; the reader recomputes both for responses
and raises if a digest differs.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import BATCH_ROWS

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"


@dataclass(frozen=True)
class Settings:
    least_bytes: int = 0
    date: str = "2024-01-01T00:00:00Z"
    level: int = 6
    range_bytes: int = 4 << 20
    chunk_bytes: int = 1 << 18


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id_of(uri: str) -> int | None:
    digits = uri[len("<urn:page:") : -1]
    return int(digits) if digits else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, s: Settings) -> bytes:
    """One uncompressed record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    header = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _uri(page_id)),
        ("WARC-Target-URI", quote(url or "", safe="!#$&'()*+,/:;=?@[]~-._")),
        ("WARC-Date", s.date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        header += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _uri(refers_to)),
        ]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in header)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int) -> bytes:
    """A gzip member that ends with a 0 byte."""

    def squeezed(data: bytes) -> bytes:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()

    out = squeezed(raw)
    return out if out.endswith(b"\0") else out + squeezed(b"")


# Writing ----------------------------------------------------------------------


def with_references(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses."""

    @F.arrow_udf("string")
    def digest(payload: pa.Array) -> pa.Array:
        return pa.array([payload_digest(p.as_buffer()) for p in payload], pa.string())

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", digest("payload"))
    large = rows.filter(F.octet_length("payload") >= s.least_bytes)
    # The column pruned aggregation gives one narrow row per digest.
    last = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    last = last.filter("n > 1").select(F.col("digest").alias("own"), "last")
    joined = rows.join(last, (F.col("digest") == F.col("own")) & (F.octet_length("payload") >= s.least_bytes), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(rows: DataFrame, path: str, s: Settings = Settings()) -> None:
    """Write the rows of ``with_references`` as archives below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                out = []
                for r in whole.slice(start, BATCH_ROWS).to_pylist():
                    revisit = r["refers_to"] is not None
                    raw = record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], revisit, s)
                    out.append(member(raw, s.level)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = rows.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("compression", "none").text(path)


# Reading ----------------------------------------------------------------------


def ranges(spark: SparkSession, path: str, s: Settings = Settings()) -> DataFrame:
    """(path, start, stop): byte ranges of all archives, dealt out evenly."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(s.range_bytes).cast("long")))
    found = files.select("path", "length", starts.alias("start"))
    found = found.select("path", "start", F.least("length", F.col("start") + s.range_bytes).alias("stop"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "path", "start")


class _Bytes:
    """A file that is read ahead in chunks."""

    def __init__(self, path: str, start: int, chunk: int):
        path = re.sub("^file:/+", "file:///", path)
        system, inside = pyarrow.fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(unquote(inside) if path.startswith("file:") else inside)
        self.path, self.base, self.chunk, self.data = path, start, chunk, b""
        self.file.seek(start)

    def upto(self, place: int) -> bool:
        """Whether the file has bytes up to ``place``, which are then at hand."""
        while self.base + len(self.data) < place:
            more = self.file.read(self.chunk)
            if not more:
                return False
            self.data += more
        return True

    def find(self, sought: bytes, place: int, stop: int) -> int | None:
        """The first place in ``[place, stop)`` where ``sought`` begins."""
        while place < stop:
            self.drop(place)
            k = self.data.find(sought)
            if k >= 0:
                return self.base + k if self.base + k < stop else None
            # Its beginning may be at hand already.
            end = self.base + len(self.data)
            place = max(place, end - len(sought) + 1)
            if not self.upto(end + 1):
                return None
        return None

    def drop(self, place: int) -> None:
        """Forget what lies before ``place``."""
        self.data = self.data[place - self.base :]
        self.base = place


def members(path: str, start: int, stop: int, s: Settings = Settings(), whole: bool = False) -> Iterator[bytes]:
    """The records whose gzip member begins in ``[start, stop)``.

    A member that begins as a record but does not decode to its end raises. With ``whole``
    the file must consist of gzip members alone: whatever lies between them raises as well.
    The member after the last one is then looked at even beyond ``stop``, so that a member
    whose beginning is damaged is missed by the range before, if not by its own.
    """
    source = _Bytes(path, start, s.chunk_bytes)
    at = 0 if whole and start == 0 else source.find(MAGIC, start, stop)
    # Whether a member must begin at ``at``.
    expected = whole and start == 0
    while at is not None and at < stop:
        raw, size = _decoded(source, at, s)
        if raw is not None and raw.startswith(VERSION):
            yield raw
        if whole and raw is not None:
            expected, at = True, at + size
            if not source.upto(at + 1):
                return
        elif expected:
            raise ValueError(f"no gzip member at byte {at} of {path}")
        else:
            at = source.find(MAGIC, at + (1 if raw is None else size), stop)
    if expected and at is not None:
        raw, _ = _decoded(source, at, s, begin=True)
        if raw is None:
            raise ValueError(f"no gzip member at byte {at} of {path}")


def _decoded(source: _Bytes, at: int, s: Settings, begin: bool = False) -> tuple[bytes | None, int]:
    """The content and size of the member at ``at``; no content if there is none.

    Of a member that holds no record the content is cut to its beginning. ``begin`` stops
    as soon as a record has begun.
    """
    source.drop(at)
    z, out, used, length, piece = zlib.decompressobj(31), [], 0, 0, b""
    is_record = None
    while not z.eof and not (is_record and begin):
        if not piece:
            if used == len(source.data) and not source.upto(at + used + 1):
                if is_record:
                    raise ValueError(f"the record at byte {at} of {source.path} is cut off")
                return None, 1
            piece = source.data[used:]
            used += len(piece)
        # The first bytes are decoded alone, so what counts as a record does not depend on the chunks.
        most = len(VERSION) - length if is_record is None else 0
        try:
            more = z.decompress(piece, most)
        except zlib.error as damage:
            if is_record:
                raise ValueError(f"the record at byte {at} of {source.path} is damaged") from damage
            return None, 1
        piece = z.unconsumed_tail
        length += len(more)
        if is_record is not False:
            out.append(more)
        if is_record is None and length >= len(VERSION):
            is_record = b"".join(out) == VERSION
    return b"".join(out), used - len(z.unused_data)


def parsed(raw: bytes) -> dict:
    """The fields of a record; the payload is what follows the HTTP header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?mi)^Content-Length: (\d+)\r?$", http)
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and payload_digest(payload) != digest:
        raise ValueError(f"digest of {fields['WARC-Record-ID']} differs from its payload")
    return {
        "page_id": _id_of(fields["WARC-Record-ID"]),
        "url": unquote(fields["WARC-Target-URI"]),
        "record_type": kind,
        "refers_to": _id_of(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload_digest": digest,
        "payload_bytes": len(payload) if kind == "response" else int(length[1]),
        "payload": payload if kind == "response" else None,
    }


RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)
COLUMNS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, s: Settings = Settings(), payloads: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``; ``payloads=False`` leaves them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, size = [], 0
                for raw in members(r["path"], r["start"], r["stop"], s, whole=True):
                    row = parsed(raw)
                    if not payloads:
                        row["payload"] = None
                    size += len(row["payload"] or b"") + 200
                    rows.append(row)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD)

    return ranges(spark, path, s).mapInArrow(run, COLUMNS)


def archived(pages: DataFrame, s: Settings = Settings(), payloads: bool = True) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write_archives(with_references(pages, s), path, s)
    return read_archives(spark, path, s, payloads)
