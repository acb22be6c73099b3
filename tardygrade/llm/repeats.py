"""Removal of long byte strings that already occurred earlier in a corpus.

Every string of ``LENGTH`` bytes has one anchor, its smallest hashed gram, so equal strings
have equal anchors. Strings of a text with the same anchor lie side by side and make up one
*window*. The steps:

1. Documents are packed into slices of some megabytes, which are written.
2. Each slice sends its distinct anchors, by hash, to be counted. Only windows whose anchor
   occurs twice can hold a repeated string.
3. Each slice sends these windows, by anchor. Equal windows are sent once per slice; the
   later ones are repeats anyway.
4. For each group of anchors a run-length index (``rindex``) is built over the windows, and
   the windows are streamed through it in corpus order: what occurs earlier is a repeat.
5. Each slice gets the repeats back and cuts them out.

A slice sends an anchor and a window once, however often it has them, so a passage that
stands in a third of all documents is spread out. An anchor that occurs in more than
``hot_slices`` slices is dealt over several groups; what these leave open, the strings of
its windows, is settled by an aggregation over 128-bit hashes.

Results. The corpus order is that of (doc_id, hash of the text); null ids come first. Of
rows with the same id and text one counts as first. Null texts are empty. Texts are taken
whole, as UTF-8 bytes; a match never crosses documents. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import fresh, int_lists, materialize
from .rindex import LENGTH, later_occurrences

NULL_ID = -(1 << 63)


@dataclass(frozen=True)
class Settings:
    """``gram`` bytes make an anchor; ``slice_bytes`` and ``block_bytes`` bound the memory of tasks."""

    length: int = LENGTH
    gram: int = 48
    slice_bytes: int = 6 << 20
    block_bytes: int = 2 << 20
    hot_slices: int = 256


# Slices -----------------------------------------------------------------------


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all().combine_chunks()


def _bytes_of(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a table as bytes, and where each begins and the last ends."""
    values = table.column(column).combine_chunks().cast(pa.large_binary())
    values = pc.fill_null(values, b"")
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]] if len(ends) else data, ends - ends[0]


def _slices(text: str, key: str, s: Settings):
    """Packs rows into slices; ``key`` is the document's id as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(waiting)
            data, ends = _bytes_of(table, text)
            own = [hashlib.blake2b(data[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends, ends[1:])]
            hashes = np.frombuffer(b"".join(own), np.int64).reshape(-1, 2)
            ids = pc.fill_null(table.column(key).cast(pa.int64()), NULL_ID).to_numpy()
            columns = [
                pa.array([number], pa.int64()),
                int_lists(ids, [len(ids)]),
                int_lists(hashes[:, 0].copy(), [len(ids)]),
                int_lists(hashes[:, 1].copy(), [len(ids)]),
                pa.array([_pack(table)], pa.binary()),
            ]
            number += 1
            return pa.RecordBatch.from_arrays(columns, names=["slice", "ids", "h1", "h2", "blob"])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy()
            begin = 0
            for row, length in enumerate(lengths.tolist()):
                size += length
                if size >= s.slice_bytes:
                    waiting.append(batch.slice(begin, row + 1 - begin))
                    yield flush()
                    waiting, begin, size = [], row + 1, 0
            if begin < batch.num_rows:
                waiting.append(batch.slice(begin))
        if waiting:
            yield flush()

    return run


# Anchors ----------------------------------------------------------------------

_MUL = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes at each place, built from those of half the width."""

    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = left * _MUL
        out += right
        out ^= out >> np.uint64(31)
        return out

    power, size = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    power ^= power >> np.uint64(29)
    whole, done = None, 0
    while True:
        if gram & size:
            n = len(data) - done - size + 1
            whole = power if whole is None else joined(whole[:n], power[done : done + n])
            done += size
        if done == gram:
            break
        power = joined(power[: len(power) - size], power[size:])
        size *= 2
    return (whole ^ (whole >> np.uint64(32))) * _MUL


def _windows_of_part(data: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the anchor of the string at each place."""
    hashes = gram_hashes(data, s.gram)
    width = s.length - s.gram + 1
    low = np.uint64((1 << 24) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    place = (least & low).astype(np.int64)
    return hashes, place


def windows(data: np.ndarray, ends: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """(document, first, last, anchor hash) of each window; first and last are string starts in ``data``."""
    found = []
    doc = 0
    while doc < len(ends) - 1:
        # Some documents at a time, or a part of a long one with its overlap.
        upto = max(doc + 1, int(np.searchsorted(ends, ends[doc] + (1 << 20), side="right")) - 1)
        for a in range(int(ends[doc]), int(ends[upto]), 1 << 21):
            b = min(int(ends[upto]), a + (1 << 21) + s.length - 1)
            if b - a < s.length:
                continue
            hashes, place = _windows_of_part(data[a:b], s)
            owner = np.repeat(np.arange(doc, upto), np.diff(ends[doc : upto + 1]))
            owner = owner[a - ends[doc] : a - ends[doc] + len(place)]
            start = np.arange(a, a + len(place))
            ok = start + s.length <= ends[owner + 1]
            owner, start, place = owner[ok], start[ok], place[ok]
            if not len(owner):
                continue
            new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
            last = start[np.r_[new[1:] - 1, len(start) - 1]]
            found.append((owner[new], start[new], last, hashes[place[new]].view(np.int64)))
        doc = upto
    if not found:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(part) for part in zip(*found))


def _group_of(anchor: np.ndarray, groups: int) -> np.ndarray:
    return ((anchor.view(np.uint64) >> np.uint64(20)) % np.uint64(groups)).astype(np.int32)


def _salt_of(number: int, salts: np.ndarray) -> np.ndarray:
    """The salt under which slice ``number`` sends each of its anchors; any long is a valid number."""
    hashed = xxhash.xxh64_intdigest(number.to_bytes(8, "little")) >> 1
    return hashed % np.maximum(salts, 1).astype(np.int64)


def _split_by(group: np.ndarray) -> list[np.ndarray]:
    """Positions of each value of ``group``."""
    order = np.argsort(group, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []


ANCHORS = "part int, slice long, anchors binary"
REPEATED = "slice long, anchors binary, salts binary"


def _anchors(text: str, groups: int, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, ends = _bytes_of(_unpack(row["blob"]), text)
                anchor, count = np.unique(windows(data, ends, s)[3], return_counts=True)
                # The lowest bit tells that the slice has it more than once.
                anchor = (anchor & ~np.int64(1)) | (count > 1)
                parts = _split_by(_group_of(anchor, groups))
                columns = [
                    pa.array([int(_group_of(anchor[k[:1]], groups)[0]) for k in parts], pa.int32()),
                    pa.array([row["slice"]] * len(parts), pa.int64()),
                    pa.array([anchor[k].tobytes() for k in parts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "slice", "anchors"])

    return run


def _count_anchors(s: Settings):
    """For each slice its anchors that occur more than once anywhere, and the salts they are dealt over."""

    def run(group: pa.Table) -> pa.Table:
        lists = [np.frombuffer(b, np.int64) for b in group.column("anchors").to_pylist()]
        anchors, inverse = np.unique(np.concatenate(lists) & ~np.int64(1), return_inverse=True)
        slices = np.bincount(inverse)
        several = np.bincount(inverse, np.concatenate(lists) & 1) > 0
        repeated = (slices > 1) | several
        salts = (-(-slices // s.hot_slices)).astype(np.int32)
        rows, at = [], 0
        for number, own in zip(group.column("slice").to_pylist(), lists):
            k = inverse[at : at + len(own)]
            at += len(own)
            k = k[repeated[k]]
            if len(k):
                rows.append((number, anchors[k].tobytes(), salts[k].tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.binary())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.Table.from_arrays(columns, names=["slice", "anchors", "salts"])

    return run


# Windows ----------------------------------------------------------------------

WINDOWS = (
    "part int, salt int, slice long, docs array<int>, starts array<int>, sizes array<int>, "
    "ids array<long>, ties array<long>, anchors array<long>, hot array<boolean>, data binary"
)
MARKS = (
    "slice long, docs array<int>, starts array<int>, counts array<int>, "
    "open array<struct<g1:long,g2:long,id:long,tie:long,doc:int,start:int>>"
)
_INTS = {"docs": np.int32, "starts": np.int32, "sizes": np.int32, "ids": np.int64, "ties": np.int64, "anchors": np.int64}


def _windows(text: str, groups: int, s: Settings):
    """Windows of the repeated anchors of a slice; repeats within the slice go with them as size 0."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[str, list] = {name.split()[0]: [] for name in WINDOWS.split(", ")}
        for row in left.to_pylist():
            _windows_of_slice(row, right, rows)
        kinds = dict(zip(rows, (pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int32())] * 3)))
        kinds |= {"ids": pa.list_(pa.int64()), "ties": pa.list_(pa.int64()), "anchors": pa.list_(pa.int64())}
        kinds |= {"hot": pa.list_(pa.bool_()), "data": pa.binary()}
        return pa.Table.from_arrays([pa.array(v, kinds[k]) for k, v in rows.items()], names=list(rows))

    def _windows_of_slice(row: dict, right: pa.Table, rows: dict[str, list]) -> None:
        data, ends = _bytes_of(_unpack(row["blob"]), text)
        ids, ties = np.array(row["ids"], np.int64), np.array(row["h1"], np.int64)
        copies = [d for part in right.column("copies").to_pylist() if part for d in part]
        is_copy = np.zeros(len(ids), bool)
        is_copy[copies] = True
        joined = b"".join(b for b in right.column("anchors").to_pylist() if b)
        repeated = np.frombuffer(joined, np.int64)
        salts = np.frombuffer(b"".join(b for b in right.column("salts").to_pylist() if b), np.int32)
        order = np.argsort(repeated)
        repeated, salts = repeated[order], salts[order]

        doc, first, last, anchor = windows(data, ends, s)
        anchor = anchor & ~np.int64(1)
        at = np.searchsorted(repeated, anchor)
        hit = at < len(repeated)
        hit[hit] = repeated[at[hit]] == anchor[hit]
        hit &= ~is_copy[doc]
        doc, first, last, anchor, salt = doc[hit], first[hit], last[hit], anchor[hit], salts[at[hit]]
        # In corpus order, so that the first of equal windows is the earliest.
        order = np.lexsort((first, ties[doc], ids[doc]))
        raw, seen, kept, again = data.tobytes(), {}, [], []
        stop = last + s.length
        bounds = list(zip(first.tolist(), stop.tolist()))
        for k in order.tolist():
            window = raw[bounds[k][0] : bounds[k][1]]
            if seen.setdefault(window, k) == k:
                kept.append(k)
            else:
                again.append(k)
        kept, again = np.array(kept, np.int64), np.array(again, np.int64)
        dealt = salt[kept] if len(kept) else np.empty(0, np.int32)
        salted = _salt_of(row["slice"], dealt)
        begin = first - ends[doc]
        whole = np.flatnonzero(is_copy & (np.diff(ends) >= s.length))

        part = _group_of(anchor[kept], groups)
        for k in _split_by(part.astype(np.int64) << 32 | salted.astype(np.int64)):
            own = kept[k]
            values = {
                "part": int(part[k[0]]),
                "salt": int(salted[k[0]]),
                "slice": row["slice"],
                "docs": doc[own].astype(np.int32),
                "starts": begin[own].astype(np.int32),
                "sizes": (stop - first)[own].astype(np.int32),
                "ids": ids[doc[own]],
                "ties": ties[doc[own]],
                "anchors": anchor[own],
                "hot": dealt[k] > 1,
                "data": b"".join([raw[bounds[i][0] : bounds[i][1]] for i in own.tolist()]),
            }
            for name, value in values.items():
                rows[name].append(value)
        done = {
            "part": int(row["slice"] % groups),
            "salt": -1,
            "slice": row["slice"],
            "docs": np.r_[doc[again], whole].astype(np.int32),
            "starts": np.r_[begin[again], np.zeros(len(whole), np.int64)].astype(np.int32),
            "sizes": np.r_[(last - first)[again] + 1, np.diff(ends)[whole] - s.length + 1].astype(np.int32),
            "ids": [],
            "ties": [],
            "anchors": [],
            "hot": [],
            "data": b"",
        }
        if len(done["docs"]):
            for name, value in done.items():
                rows[name].append(value)

    return run


def _match(s: Settings):
    """Repeats among the windows of one group; groups of salt -1 hold repeats that are known."""

    def run(group: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if group.column("salt")[0].as_py() < 0:
            for row in group.select(["slice", "docs", "starts", "sizes"]).to_pylist():
                out.append((row["slice"], row["docs"], row["starts"], row["sizes"], None))
            return _marks(out)
        flat = {name: group.column(name).combine_chunks().flatten().to_numpy() for name in _INTS}
        hot = group.column("hot").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        slices = np.repeat(group.column("slice").to_numpy(), pc.list_value_length(group.column("docs")).to_numpy())
        data = b"".join(group.column("data").to_pylist())
        stop = np.cumsum(flat["sizes"], dtype=np.int64)
        order = np.lexsort((flat["starts"], flat["ties"], flat["ids"], flat["anchors"]))

        # Blocks of whole anchors.
        anchors = flat["anchors"][order]
        edges = np.r_[np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]]), len(order)]
        volume = np.r_[0, np.cumsum(flat["sizes"][order], dtype=np.int64)]
        marks, opened, begin = [], [], 0
        for edge in range(1, len(edges)):
            last = edge == len(edges) - 1
            if last or volume[edges[edge + 1]] - volume[edges[begin]] > s.block_bytes:
                block = order[edges[begin] : edges[edge]]
                _match_block(block, flat, hot, slices, data, stop, marks, opened)
                begin = edge
        return _marks(_rows_of_marks(marks, opened))

    def _match_block(block, flat, hot, slices, data, stop, marks, opened) -> None:
        # In corpus order; equal windows of other slices are repeats as a whole.
        block = block[np.lexsort((flat["starts"][block], flat["ties"][block], flat["ids"][block]))]
        first, size, order = {}, flat["sizes"], []
        for k in block.tolist():
            window = data[stop[k] - size[k] : stop[k]]
            if window in first:
                marks.append((k, slices[k], flat["docs"][k], flat["starts"][k], size[k] - s.length + 1))
            else:
                first[window] = k
                order.append(k)
        # Strings are equal only under one anchor, and a window has no string twice. So what
        # is alone under its anchor repeats nothing, and only the others are indexed.
        own = flat["anchors"][order]
        anchors, count = np.unique(own, return_counts=True)
        shared = (count > 1)[np.searchsorted(anchors, own)].tolist()
        found = later_occurrences([w for w, yes in zip(first, shared) if yes], s.length) if any(shared) else []
        parts = iter(found)
        later = [next(parts) if yes else np.empty(0, np.int64) for yes in shared]
        for k, window, offsets in zip(order, first, later):
            if len(offsets):
                cut = np.flatnonzero(np.diff(offsets) > 1)
                for a, b in zip(np.r_[0, cut + 1], np.r_[cut, len(offsets) - 1]):
                    start = flat["starts"][k] + offsets[a]
                    marks.append((k, slices[k], flat["docs"][k], start, offsets[b] - offsets[a] + 1))
            if hot[k]:
                for offset in np.setdiff1d(np.arange(size[k] - s.length + 1), offsets).tolist():
                    digest = hashlib.blake2b(window[offset : offset + s.length], digest_size=16).digest()
                    g1, g2 = np.frombuffer(digest, np.int64).tolist()
                    own = dict(g1=g1, g2=g2, id=int(flat["ids"][k]), tie=int(flat["ties"][k]))
                    opened.append((slices[k], own | dict(doc=int(flat["docs"][k]), start=int(flat["starts"][k]) + offset)))

    return run


def _rows_of_marks(marks: list[tuple], opened: list[tuple]) -> list[tuple]:
    """One row for each slice that gets something."""
    rows = []
    if marks:
        _, number, doc, start, count = (np.array(x, np.int64) for x in zip(*marks))
        for k in _split_by(number):
            rows.append((int(number[k[0]]), doc[k], start[k], count[k], None))
    by_slice: dict[int, list] = {}
    for number, gram in opened:
        by_slice.setdefault(int(number), []).append(gram)
    return rows + [(number, [], [], [], grams) for number, grams in by_slice.items()]


_OPEN = pa.list_(pa.struct([(n, pa.int64()) for n in ("g1", "g2", "id", "tie")] + [(n, pa.int32()) for n in ("doc", "start")]))


def _marks(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), *[pa.list_(pa.int32())] * 3, _OPEN]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.Table.from_arrays(columns, names=["slice", "docs", "starts", "counts", "open"])


# Cutting ----------------------------------------------------------------------


def _marked(table: pa.Table, text: str, right: pa.Table, s: Settings) -> tuple[np.ndarray, ...]:
    """Bytes of a slice, bounds of its texts, and which places are to go; a free place follows each text."""
    data, ends = _bytes_of(table, text)
    gap = ends + np.arange(len(ends))
    change = np.zeros(int(gap[-1]) + 1, np.int32)
    for marks in right.select(["docs", "starts", "counts"]).to_pylist():
        if marks["docs"]:
            doc, start, count = (np.array(marks[c], np.int64) for c in ("docs", "starts", "counts"))
            np.add.at(change, gap[doc] + start, 1)
            np.add.at(change, gap[doc] + start + count - 1 + s.length, -1)
    return data, ends, gap, np.cumsum(change)[: int(gap[-1])] > 0


def _rest(data: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """The kept bytes of each text."""
    offsets = np.r_[0, np.cumsum(kept)][ends]
    rest = data[kept].tobytes()
    return [rest[a:b] for a, b in zip(offsets, offsets[1:])]


def _cut(text: str, drop: str, names: list[str], s: Settings):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for row in left.to_pylist():
            table = _unpack(row["blob"])
            data, ends, gap, gone = _marked(table, text, right, s)
            n, sizes = len(ends) - 1, np.diff(ends)
            edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
            begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
            owner = np.searchsorted(gap, begin, side="right") - 1
            per_doc = np.bincount(owner, minlength=n)
            spans = pa.StructArray.from_arrays(
                [pa.array((begin - gap[owner]).astype(np.int32)), pa.array((end - gap[owner]).astype(np.int32))],
                names=["start", "end"],
            )
            kept = ~gone[np.arange(len(data)) + np.repeat(np.arange(n), sizes)]
            added = [
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_doc)].astype(np.int32)), spans),
                pa.array(_rest(data, ends, kept), pa.binary()),
            ]
            columns = [table.column(c).combine_chunks() for c in table.column_names if c not in (drop, *names)]
            kept_names = [c for c in table.column_names if c not in (drop, *names)]
            tables.append(pa.Table.from_arrays([*columns, *added], names=[*kept_names, *names]))
        return pa.concat_tables(tables) if tables else None

    return run


def _cut_text(text: str, drop: str, s: Settings):
    """Slices with the kept part of their texts; a character that is cut in part stays whole."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for row in left.to_pylist():
            table = _unpack(row["blob"])
            data, ends, _, gone = _marked(table, text, right, s)
            kept = ~gone[np.arange(len(data)) + np.repeat(np.arange(len(ends) - 1), np.diff(ends))]
            letter = np.cumsum((data & 0xC0) != 0x80)
            stays = np.zeros(int(letter[-1]) + 1 if len(letter) else 1, bool)
            stays[letter[kept]] = True
            rest = pa.array([part.decode() for part in _rest(data, ends, stays[letter])], pa.string())
            table = table.drop_columns([drop])
            tables.append(table.set_column(table.column_names.index(text), text, rest))
        return pa.concat_tables(tables)

    return run


def _slices_and_marks(df: DataFrame, id_col: str, text_col: str, key: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """The slices of ``df`` and, for each, what is to be cut out of it."""
    spark = df.sparkSession
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn(key, F.col(id_col).cast("long"))
    kind = "slice long, ids array<long>, h1 array<long>, h2 array<long>, blob binary"
    slices = materialize(keyed.mapInArrow(_slices(text_col, key, s), kind), "slices")

    anchors = slices.select("slice", "blob").mapInArrow(_anchors(text_col, groups, s), ANCHORS)
    repeated = anchors.groupBy("part").applyInArrow(_count_anchors(s), REPEATED)

    docs = slices.select("slice", F.posexplode(F.arrays_zip("ids", "h1", "h2")).alias("doc", "d"))
    docs = docs.select("d.h1", "d.h2", F.struct("d.ids", "slice", "doc").alias("place"))
    first = docs.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = docs.join(first, ["h1", "h2"]).filter("place > first").groupBy("place.slice")
    copies = copies.agg(F.collect_list("place.doc").alias("copies"))

    none = F.lit(None)
    info = repeated.withColumn("copies", none.cast("array<int>")).unionByName(
        copies.withColumns({"anchors": none.cast("binary"), "salts": none.cast("binary")})
    )
    sent = slices.groupBy("slice").cogroup(info.groupBy("slice")).applyInArrow(_windows(text_col, groups, s), WINDOWS)
    matched = materialize(sent.groupBy("part", "salt").applyInArrow(_match(s), MARKS), "marks")

    left = matched.filter("open is not null").select("slice", F.explode("open").alias("o")).select("slice", "o.*")
    order = F.struct("id", "tie", "start")
    least = left.groupBy("g1", "g2").agg(F.min(order).alias("first"))
    settled = left.join(least, ["g1", "g2"]).filter(order > F.col("first"))
    settled = settled.select("slice", *[F.array(c).alias(a) for a, c in (("docs", "doc"), ("starts", "start"))])
    marks = matched.select("slice", "docs", "starts", "counts").unionByName(
        settled.withColumn("counts", F.array(F.lit(1)))
    )
    return slices.select("slice", "blob").groupBy("slice"), marks.groupBy("slice")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """Adds n_bytes, spans (removed byte ranges) and kept (the other bytes) to every row of ``df``."""
    key, names = fresh(df, "order_key"), ["n_bytes", "spans", "kept"]
    slices, marks = _slices_and_marks(df, id_col, text_col, key, s)
    schema = StructType([f for f in df.schema if f.name not in names])
    span = StructType().add("start", IntegerType()).add("end", IntegerType())
    schema = schema.add("n_bytes", "long").add("spans", ArrayType(span)).add("kept", "binary")
    return slices.cogroup(marks).applyInArrow(_cut(text_col, key, names, s), schema)


def cut_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """The rows of ``df`` with repeats cut out of their texts, in whole characters."""
    key = fresh(df, "order_key")
    slices, marks = _slices_and_marks(df, id_col, text_col, key, s)
    return slices.cogroup(marks).applyInArrow(_cut_text(text_col, key, s), df.schema)
