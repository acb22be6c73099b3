"""Conversations repaired to the grammar ``(s?(ua)+)?`` of role initials at the least cost.

Method. Rows of a conversation are edited into a target, a string of the grammar: a row is kept
(0), given the role user or assistant (2) or deleted (3), and empty turns of either are inserted
(2). A blank row and one whose role and text came earlier must be deleted; a truncated row that
stays adds 1. There is one target for each length and beginning, and each that can pay is
aligned as in Wagner and Fischer's table. Targets come in the order of what their length costs
at least; the least cost so far ends that order and bounds the band of diagonals of each table,
as in Ukkonen's. The edits are read off the table; of several at the least cost the string of
initials (D, I, K, R) that comes first counts, within a target and between targets. A sequence of more
than ``chunk`` rows is aligned chunk by chunk, from each role that can come before a chunk to
each that can end it, and the chunks are joined by cost and string.

Rows travel as codes of one byte, cut into pieces of bounded size by ranges of the order, so a
conversation may be longer than a task holds. Texts are shuffled once, to be put in order;
they stream past the edits, and nothing but the edit string of one conversation is held.

Results. See ``audits``, ``repaired`` and ``digests``. Rows are in the order of turn (nulls first),
then role, then the MD5 of the text; equal rows are next to each other, and all but the first are
duplicates. A null role or text is one blank, so such a text is a blank row. A null conversation
id is a conversation like others. Texts of any length are taken whole; roles other than those
that begin with s, u or a can only be changed or deleted. Further columns are not looked at. An
empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, strings


@dataclass(frozen=True)
class Settings:
    """``chunk`` rows are aligned in one table, ``piece`` rows are a row of codes."""

    chunk: int = 32
    piece: int = 4096


# Costs of the edits.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

# Alignment --------------------------------------------------------------------

# A row's code is 3 * (place of its initial here) + fault.
INITIALS = "suao"  # o: any other
FINE, CUT_SHORT, DOOMED = range(3)
_FAR = 1 << 60
Found = dict[str, tuple[int, str]]


def code_of(initial: str, fault: int) -> int:
    return 3 * (INITIALS.find(initial) if initial and initial in "sua" else 3) + fault


def _off(shift: int) -> int:
    """What it costs at least to bring rows and target apart by so many places."""
    return INSERT * shift if shift >= 0 else -DELETE * shift


def _target(head: str, first: str, size: int) -> str:
    """The first ``size`` letters of ``head`` and then u and a in turn, beginning with ``first``."""
    return (head + (first + ("a" if first == "u" else "u")) * (size // 2 + 1))[:size]


def _aligned(codes: bytes, target: str, limit: int) -> tuple[int, str] | None:
    """Least cost and first string of edits that turn ``codes`` into ``target``, None above ``limit``."""
    rows, size = len(codes), len(target)
    stay = [0]
    for code in codes:
        stay.append(stay[-1] + (code % 3 != DOOMED))
    forced = DELETE * (rows - stay[-1])
    end = size - stay[-1]
    # Diagonals, by how far the target is ahead of the rows that may stay, that can be within the limit.
    low, high = min(0, end), max(0, end)
    if _off(end) + forced > limit:
        return None
    while low > -rows and _off(low - 1) + _off(end - low + 1) + forced <= limit:
        low -= 1
    while high < size and _off(high + 1) + _off(end - high - 1) + forced <= limit:
        high += 1

    table: list[dict[int, int]] = [{} for _ in range(rows + 1)]
    for i in range(rows, -1, -1):
        here, below = table[i], table[i + 1] if i < rows else {}
        letter, fault = (INITIALS[codes[i] // 3], codes[i] % 3) if i < rows else ("", DOOMED)
        for j in range(min(size, stay[i] + high), max(0, stay[i] + low) - 1, -1):
            best = 0 if i == rows and j == size else _FAR
            if j < size:
                best = min(best, INSERT + here.get(j + 1, _FAR))
                if fault != DOOMED and (letter == target[j] or target[j] != "s"):
                    step = (0 if letter == target[j] else REROLE) + (TRUNCATED if fault == CUT_SHORT else 0)
                    best = min(best, step + below.get(j + 1, _FAR))
            here[j] = min(best, DELETE + below.get(j, _FAR))
    cost = table[0].get(0, _FAR)
    if cost > limit or cost >= _FAR:
        return None

    edits, i, j = [], 0, 0
    while i < rows or j < size:
        left = table[i][j]
        if i < rows and table[i + 1].get(j, _FAR) + DELETE == left:
            edits.append("D")
            i += 1
        elif j < size and table[i].get(j + 1, _FAR) + INSERT == left:
            edits.append("I")
            j += 1
        else:
            edits.append("K" if INITIALS[codes[i] // 3] == target[j] else "R")
            i, j = i + 1, j + 1
    return cost, "".join(edits)


@lru_cache(maxsize=1 << 14)
def align(codes: bytes, before: str) -> Found:
    """Least cost and first edits for each role that can end, after the role ``before`` ('' at the beginning).

    An end of '' means that nothing has come yet.
    """
    stay = sum(code % 3 != DOOMED for code in codes)
    forced = DELETE * (len(codes) - stay)
    heads = [("", "u"), ("s", "u")] if before == "" else [("", "a" if before == "u" else "u")]
    sizes = sorted(range(2 * len(codes) + 4), key=lambda size: _off(size - stay))
    best: Found = {}
    for size in sizes:
        for head, first in heads:
            if size < len(head):
                continue
            target = _target(head, first, size)
            end = target[-1] if target else before
            limit = best[end][0] if end in best else _FAR - 1
            if forced + _off(size - stay) > limit:
                continue
            found = _aligned(codes, target, limit)
            if found and (end not in best or found < best[end]):
                best[end] = found
    return best


def joined(state: Found, step: dict[str, Found]) -> Found:
    """The best of what ends in each role after a further step."""
    best: Found = {}
    for before, (cost, edits) in state.items():
        for end, (more, behind) in step[before].items():
            found = cost + more, edits + behind
            if end not in best or found < best[end]:
                best[end] = found
    return best


def aligned_piece(codes: bytes, before: str, s: Settings = Settings()) -> Found:
    """``align`` for any number of rows."""
    state: Found = {before: (0, "")}
    for start in range(0, len(codes), s.chunk):
        chunk = codes[start : start + s.chunk]
        state = joined(state, {role: align(chunk, role) for role in state})
    return state


def whole(state: Found) -> tuple[int, str]:
    """The best of the ends that the grammar allows: nothing, or an answer."""
    return min(state[end] for end in ("", "a") if end in state)


# Codes of conversations ---------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, key, turn, role, text, digest): rows with a key that tells a null id apart."""
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    filled = [F.coalesce(F.col(c), F.lit(" ")).alias(name) for c, name in ((role, "role"), (text, "text"))]
    rows = df.select(F.col(conv).alias("conv"), key.alias("key"), F.col(turn).alias("turn"), *filled)
    return rows.withColumn("digest", F.unhex(F.md5("text")))


ORDER = ("turn", "role", "digest")


def _ordered() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def _judged(rows: DataFrame) -> DataFrame:
    """One narrow row for equal rows: their number, the faults of the text and whether it comes here first."""
    ending = F.rtrim("text", F.lit(WHITE))
    narrow = rows.select(
        "conv",
        "key",
        *ORDER,
        (ending == "").alias("blank"),
        (~F.substring(ending, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    same = narrow.groupBy("key", *ORDER).agg(
        F.first("conv").alias("conv"), F.first("blank").alias("blank"), F.first("open").alias("open"), F.count("*").alias("n")
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    earliest = same.groupBy("key", "role", "digest").agg(F.min(place).alias("earliest"))
    return same.join(earliest, ["key", "role", "digest"]).withColumn("first", place.eqNullSafe(F.col("earliest"))).drop("earliest")


def _counted(judged: DataFrame) -> DataFrame:
    """(key, conv, gaps, blank, duplicate, truncated) of each conversation."""
    first = F.col("first").cast("long")
    spread = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    total = lambda found, n: F.coalesce(F.sum(F.when(found, n)), F.lit(0)).cast("long")
    return judged.groupBy("key").agg(
        F.first("conv").alias("conv"),
        F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"),
        total(F.col("blank"), F.col("n")).alias("blank"),
        total(~F.col("blank"), F.col("n") - first).alias("duplicate"),
        total(~F.col("blank") & F.col("open"), first).alias("truncated"),
    )


_PIECE = "key string, place long, opens boolean, steps array<struct<before:string,end:string,cost:long,edits:string>>, codes binary"


def _pieces_of(s: Settings):
    """Aligned pieces of conversations from rows (key, code) in order."""

    def piece(key: str, place: int, opens: bool, codes: bytes) -> dict:
        steps = []
        for before in [""] if opens else ["", "s", "u", "a"]:
            for end, (cost, edits) in aligned_piece(codes, before, s).items():
                steps.append({"before": before, "end": end, "cost": cost, "edits": edits})
        return {"key": key, "place": place, "opens": opens, "steps": steps, "codes": codes}

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode()
            numbers, codes = keys.indices.to_numpy(), batch.column(1).to_numpy().astype(np.uint8).tobytes()
            edges = np.r_[0, np.flatnonzero(np.diff(numbers)) + 1, len(numbers)]
            for a, b in zip(edges, edges[1:]):
                yield keys.dictionary[numbers[a]].as_py(), codes[a:b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 33
        kind = pa.schema(
            [
                ("key", pa.string()),
                ("place", pa.int64()),
                ("opens", pa.bool_()),
                ("steps", pa.list_(pa.struct([("before", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("edits", pa.string())]))),
                ("codes", pa.binary()),
            ]
        )
        # A conversation may go on from the task before, so the first one may have any role before it.
        key, held, opens, out = None, b"", False, []
        for own, codes in runs(batches):
            if key is not None and own != key:
                out.append(piece(key, place, opens, held))
                place, held, opens = place + 1, b"", True
            key, held = own, held + codes
            while len(held) > s.piece:
                out.append(piece(key, place, opens, held[: s.piece]))
                place, held, opens = place + 1, held[s.piece :], False
            if len(out) >= 512:
                yield pa.RecordBatch.from_pylist(out, kind)
                out = []
        if key is not None:
            out.append(piece(key, place, opens, held))
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return run


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, illegal, cost, audit) of conversations from their pieces."""
    legal = {INITIALS.index(a) * 4 + INITIALS.index(b) for a, b in ("su", "ua", "au")}
    wrong = np.array([k not in legal for k in range(16)])
    for batch in batches:
        rows = []
        for key, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            state: Found = {"": (0, "")}
            for part in parts:
                steps: dict[str, Found] = {role: {} for role in ("", "s", "u", "a")}
                for step in part["steps"]:
                    steps[step["before"]][step["end"]] = step["cost"], step["edits"]
                state = joined(state, steps)
            initials = np.frombuffer(b"".join(part["codes"] for part in parts), np.uint8) // 3
            rows.append((key, int(wrong[initials[:-1] * 4 + initials[1:]].sum()), *whole(state)))
        columns = [[r[k] for r in rows] for k in range(4)]
        arrays = [strings(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), strings(columns[3])]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "illegal", "cost", "audit"])


def _audited(rows: DataFrame, s: Settings) -> DataFrame:
    judged = materialize(_judged(rows), "turns")
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    doomed = F.col("blank") | ~F.col("first") | (F.col("copy") > 1)
    fault = F.when(doomed, DOOMED).when(F.col("open"), CUT_SHORT).otherwise(FINE)
    codes = judged.withColumn("copy", copy).select("key", (number * 3 + fault).cast("int").alias("code"), *ORDER, "copy")

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc("key"), *_ordered(), F.asc("copy")]
    pieces = codes.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "code")
    pieces = pieces.mapInArrow(_pieces_of(s), _PIECE)
    lists = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "steps", "codes"))).alias("pieces"))
    found = lists.mapInArrow(_wholes, "key string, illegal long, cost long, audit string")
    return materialize(_counted(judged).join(found, "key"), "audits")


def audits(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """(key, conv, gaps, blank, duplicate, truncated, illegal, cost, audit), one row per conversation of ``df``.

    ``gaps`` are missing turn numbers between the first and the last, ``illegal`` the neighbours
    whose initials are not su, ua or au, before the repair. ``blank``, ``duplicate`` and
    ``truncated`` count rows by their first fault. ``audit`` has the initials of the edits.
    ``key`` tells conversations apart, also that of a null id.
    """
    return _audited(_rows(df, conv, turn, role, text), s)


# Repaired texts -----------------------------------------------------------------


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, conv, edit, role, text) of the repaired rows, and (key, conv, None, None, None) after each conversation."""
    key = conv = None
    audit, at, before = "", 0, ""

    def inserted() -> Iterator[tuple]:
        nonlocal at, before
        while at < len(audit) and audit[at] == "I":
            before = "assistant" if before[:1] == "u" else "user"
            at += 1
            yield key, conv, "I", before, ""

    for batch in batches:
        for own, ident, is_text, role, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if not is_text:
                if key is not None:
                    yield from inserted()
                    yield key, conv, None, None, None
                key, conv, audit, at, before = own, ident, text, 0, ""
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "R":
                role = "assistant" if before[:1] == "u" else "user"
            if edit != "D":
                before = role
                yield key, conv, edit, role, text
    if key is not None:
        yield from inserted()
        yield key, conv, None, None, None


def _streams(df: DataFrame, audited: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The audit and the rows of each conversation, in order, next to each other."""
    rows = _rows(df, conv, turn, role, text).select("key", "conv", F.lit(True).alias("is_text"), "turn", "role", "digest", "text")
    nothing = rows.schema["turn"].dataType
    heads = audited.select(
        "key", "conv", F.lit(False).alias("is_text"), F.lit(None).cast(nothing).alias("turn"), F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"),
    )
    both = heads.unionByName(rows).repartition("key").sortWithinPartitions("key", "is_text", *_ordered())
    return both.select("key", "conv", "is_text", "role", "text")


def repaired(df: DataFrame, audited: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, edit, role, text): the rows of the repaired conversations, ``place`` from 0 on."""
    streams = _streams(df, audited, conv, turn, role, text)
    kind = streams.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, place, out, conv_kind = ["conv", "place", "edit", "role", "text"], 0, [], None

        def taken() -> Iterator[pa.RecordBatch]:
            nonlocal conv_kind
            for batch in batches:
                conv_kind = batch.schema.field(1).type
                yield batch

        def rows() -> pa.RecordBatch:
            kinds = [conv_kind, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

        for _, ident, edit, own, said in _edited(taken()):
            if edit is None:
                place = 0
                continue
            out.append((ident, place, edit, own, said))
            place += 1
            if len(out) >= 256:
                yield rows()
                out = []
        if out:
            yield rows()

    return streams.mapInArrow(run, f"conv {kind}, place long, edit string, role string, text string")


def digests(df: DataFrame, audited: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, sha256): digest of the repaired rows ``role:text``, joined by line ends, of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, digest, between = [], hashlib.sha256(), ""
        for key, _, edit, own, said in _edited(batches):
            if edit is None:
                found.append((key, digest.hexdigest()))
                digest, between = hashlib.sha256(), ""
            else:
                digest.update(f"{between}{own}:{said}".encode())
                between = "\n"
        yield pa.RecordBatch.from_arrays([strings(r[k] for r in found) for k in (0, 1)], names=["key", "sha256"])

    return _streams(df, audited, conv, turn, role, text).mapInArrow(run, "key string, sha256 string")
