"""Near duplicates by the Jaccard similarity of word pairs, found with fast similarity sketches.

Method. A sketch has ``size`` coordinates that are filled in rounds. In each of the first ``size``
rounds every shingle of a set is thrown into a random coordinate with a random value, and a
coordinate that was empty before the round keeps the smallest value thrown at it. In ``size``
further rounds all shingles are thrown at one coordinate, a different one each time, so every
coordinate is full in the end; usually it is after a few rounds, so that a set of n shingles
costs n + size * log(size) throws instead of n * size. Two sets agree in a coordinate with the
probability of their similarity, and the number of agreements is concentrated as that of
independent throws, which gives the bound below which a pair is not checked.

Equal sets are one class. Sketches are cut into bands; classes that share a band are a bucket.
First each class is compared with the smallest class of its buckets, on the full sets; what is
linked is one component. Buckets that lie in one component are done, so a large group of near
copies costs one comparison each. In the other buckets every two classes of different
components whose sketches allow it are compared on the full sets, in groups of bounded size.
Pairs are never listed: a group returns links that span what it found.

Results. One row per row of the input, as described at ``near_duplicates``. Letters A-Z are
lower-cased, ASCII white space separates words. A text of one word is one shingle; null texts
and texts without words have no shingles and no links. Texts are taken whole, in parts that are
cut between words. A null doc_id never names a component, unless all of it are null; rows that
repeat a doc_id are separate rows. Further columns are not looked at. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, comb, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binaries, materialize, pieces
from .graph import components
from .wordhash import WINDOW, mixed, windows, word_hashes


@dataclass(frozen=True)
class Settings:
    """A pair of similarity 0.8 shares none of 30 bands of 5 values with a probability of
    (1 - 0.8^5)^30, seven in a million, and pairs above it more rarely. ``miss`` is the probability that a
    pair at the threshold agrees in too few coordinates to be checked. ``block`` bounds the
    texts of one side of a group."""

    words: int = 2
    percent: int = 80
    bands: int = 30
    rows: int = 5
    miss: float = 1e-6
    block: int = 512

    @property
    def size(self) -> int:
        return self.bands * self.rows


# Shingles and sketches ----------------------------------------------------------

# A-Z in lower case, white space as blanks.
_PLAIN = bytes(32 if i in b" \t\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))


def _plain(text: str) -> bytes:
    return text.encode().translate(_PLAIN)


def _shingled(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles of the words of one text, distinct and sorted."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    total = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, min(width, len(words))):
        total = (total + words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
    # Shorter sequences than ``width`` are told apart by their length.
    return np.unique(mixed(total + np.uint64(min(width, len(words)))))


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The hashed shingle set of each text. Texts are hashed together, up to some bytes at a time."""
    held: list[bytes] = []

    def flush() -> Iterator[np.ndarray]:
        raw, ends = b"\n".join([*held, b""]), np.cumsum([len(x) + 1 for x in held])
        found, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for place, part in windows(raw):
            hashes, start, _ = word_hashes(part)
            found.append(hashes)
            starts.append(start + place)
        words, stops = np.concatenate(found), np.searchsorted(np.concatenate(starts), ends)
        for a, b in zip([0, *stops[:-1]], stops):
            yield _shingled(words[a:b], width)
        held.clear()

    size = 0
    for text in texts:
        held.append(_plain(text or ""))
        size += len(held[-1])
        if size >= WINDOW:
            yield from flush()
            size = 0
    yield from flush()


@lru_cache(maxsize=4)
def _throws(size: int) -> tuple[np.ndarray, np.ndarray]:
    """A random function for each of the ``2 * size`` rounds."""
    random = np.random.default_rng(20_170_504)
    factor, shift = random.integers(0, 1 << 64, (2, 2 * size, 1), np.uint64)
    return factor | np.uint64(1), shift


def sketch(shingles: np.ndarray, size: int) -> np.ndarray:
    """The round (upper half) and value (lower half) that fill each coordinate for a set that is not empty."""
    factor, shift = _throws(size)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    found = np.full(size, empty)
    # As many rounds at once as usually fill all coordinates.
    step = min(size, max(1, ceil(1.3 * size * log(size + 1) / len(shingles))))
    for first in range(0, size, step):
        rounds = slice(first, min(first + step, size))
        thrown = mixed(shingles * factor[rounds] + shift[rounds])
        at = ((thrown >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        # The smallest key of a coordinate is in the first round that reaches it.
        key = np.arange(rounds.start, rounds.stop, dtype=np.uint64)[:, None] << np.uint64(32)
        key = key | (thrown & np.uint64(0xFFFFFFFF))
        now = np.full(size, empty)
        np.minimum.at(now, at.ravel(), key.ravel())
        np.copyto(found, now, where=found == empty)
        if not (found == empty).any():
            return found
    for k in np.flatnonzero(found == empty):
        thrown = mixed(shingles * factor[size + k] + shift[size + k])
        found[k] = np.uint64(size + k) << np.uint64(32) | (thrown & np.uint64(0xFFFFFFFF)).min()
    return found


def short(sketched: np.ndarray) -> np.ndarray:
    """16 bits of each coordinate, which are equal by chance once in 65,536."""
    return (mixed(sketched) >> np.uint64(48)).astype(np.uint16)


def band_keys(sketches: np.ndarray, s: Settings) -> np.ndarray:
    """A 64-bit key for each band of each row of ``sketches``; the band's number is part of it."""
    values = sketches.reshape(len(sketches), s.bands, s.rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, s.bands + 1, dtype=np.uint64), values.shape[:2])
    for k in range(s.rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
    return keys.view(np.int64)


@lru_cache(maxsize=16)
def least_equal(size: int, percent: int, miss: float) -> int:
    """The fewest agreeing coordinates with which a pair is checked."""
    share, total = percent / 100, 0.0
    for m in range(size + 1):
        total += comb(size, m) * share**m * (1 - share) ** (size - m)
        if total >= miss:
            return m
    return size


def _sketched(s: Settings, id_kind: str):
    """(doc_id, h1, h2, s1, s2, n, sketch) of rows (doc_id, h1, h2, text); s1 and s2 tell sets apart."""
    salts = np.array([0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                sums, sizes, sketches = [], [], []
                for shingles in shingle_sets(batch.column(3).to_pylist(), s.words):
                    sums.append(mixed(shingles ^ salts).sum(axis=1, dtype=np.uint64).view(np.int64))
                    sizes.append(len(shingles))
                    sketches.append(short(sketch(shingles, s.size)).tobytes() if len(shingles) else b"")
                s1, s2 = np.stack(sums).T if sums else np.empty((2, 0), np.int64)
                columns = [*batch.columns[:3], pa.array(s1), pa.array(s2), pa.array(sizes, pa.int64()), binaries(sketches)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h1", "h2", "s1", "s2", "n", "sketch"])

    return run, f"doc_id {id_kind}, h1 long, h2 long, s1 long, s2 long, n long, sketch binary"


def _banded(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                raw = b"".join(batch.column(1).to_pylist())
                keys = band_keys(np.frombuffer(raw, np.uint16).reshape(-1, s.size), s)
                columns = [pa.array(np.repeat(batch.column(0).to_numpy(), s.bands)), pa.array(keys.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "key"])

    return run


# Comparing full sets ----------------------------------------------------------


def exact_sets(members: list[str], width: int) -> list[np.ndarray]:
    """Shingle sets as sorted numbers that are equal only for equal sequences of words."""
    numbers: dict[bytes, int] = {}
    found = []
    for text in members:
        ids = np.array([numbers.setdefault(w, len(numbers) + 1) for w in _plain(text).split()], np.int64)
        found.append(np.pad(ids, (0, max(0, width - len(ids)))) if len(ids) else ids)
    sizes = [len(x) for x in found]
    ids, ends = np.concatenate([np.empty(0, np.int64), *found]), np.cumsum([0, *sizes])
    codes = ids
    for k in range(1, width):
        following = np.zeros_like(ids)
        following[: max(0, len(ids) - k)] = ids[k:]
        codes = np.unique(codes * (len(numbers) + 1) + following, return_inverse=True)[1].reshape(-1)
    return [np.unique(codes[a : max(a, b - width + 1)]) for a, b in zip(ends, ends[1:])]


class Against:
    """Compares sets with one set."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.inside = np.zeros(max((int(x[-1]) for x in sets if len(x)), default=0) + 1, bool)

    def linked(self, one: int, others: np.ndarray) -> np.ndarray:
        own = self.sets[one]
        self.inside[own] = True
        common = np.array([self.inside[self.sets[k]].sum() for k in others], np.int64)
        self.inside[own] = False
        union = len(own) + np.array([len(self.sets[k]) for k in others], np.int64) - common
        return (common > 0) & (100 * common >= self.percent * union)


_LINK = "a long, b long"


def _stars(s: Settings):
    """Links of the members of a group with its centre."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        nodes = group["node"].to_numpy()
        centre = int(np.flatnonzero(nodes == group["centre"].iloc[0])[0])
        others = np.delete(np.arange(len(nodes)), centre)
        hit = others[Against(exact_sets(list(group["text"]), s.words), s.percent).linked(centre, others)]
        return pd.DataFrame({"a": nodes[hit], "b": np.full(len(hit), nodes[centre])})

    return run


def _across(s: Settings):
    """Links that span what is similar among the classes of a group, those known before left out."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "node"], ignore_index=True)
        nodes, side = group["node"].to_numpy(), group["side"].to_numpy()
        sketches = np.frombuffer(b"".join(group["sketch"]), np.uint16).reshape(-1, s.size)
        # Numbers of components, which fall together as links are found.
        part = np.unique(group["root"], return_inverse=True)[1].reshape(-1)
        least = least_equal(s.size, s.percent, s.miss)
        against, links = None, []
        for one in range(len(nodes)):
            # Two sides: each of the left with each of the right. One side: each with those behind it.
            behind = np.arange(one + 1, len(nodes))
            others = behind[(part[behind] != part[one]) & ((side[behind] != side[one]) | (side[0] == side[-1]))]
            others = others[(sketches[others] == sketches[one]).sum(axis=1) >= least]
            if not len(others):
                continue
            against = against or Against(exact_sets(list(group["text"]), s.words), s.percent)
            for other in others[against.linked(one, others)]:
                if part[other] != part[one]:
                    links.append((nodes[one], nodes[other]))
                    part[part == part[other]] = part[one]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


# The whole job ----------------------------------------------------------------


def _identity(text: str) -> list[Column]:
    """128 bits that tell texts apart."""
    text = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with ``root``, the smallest node that links lead to."""
    return nodes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _first_links(members: DataFrame, buckets: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Links of each class with the smallest class of its buckets."""
    pairs = members.join(buckets, "key").filter("node != first").groupBy("node").agg(F.min("first").alias("centre"))
    pairs = materialize(pairs, "stars")
    sizes = pairs.groupBy("centre").agg(F.ceil(F.count("*") / s.block).cast("int").alias("salts"))
    salt = F.expr("cast(pmod(xxhash64(node), salts) as int)")
    outer = pairs.join(sizes, "centre").select("centre", salt.alias("salt"), "node")
    inner = sizes.select("centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("centre").alias("node"))
    groups = outer.unionByName(inner).join(texts.select("node", "text"), "node").groupBy("centre", "salt")
    return materialize(groups.applyInPandas(_stars(s), _LINK), "links")


def _other_links(members: DataFrame, buckets: DataFrame, rooted: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Links between components that share a bucket.

    The classes that such buckets connect are a field. Its large components have blocks of
    their own, the small ones share some; no block is compared with one of its own component.
    """
    placed = members.join(buckets.select("key", "first"), "key").join(rooted.select("node", "root"), "node")
    still = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least != most")
    shared = placed.join(still.select("key"), "key")
    fields = components(shared.select(F.col("node").alias("a"), F.col("first").alias("b")))
    fields = fields.withColumnRenamed("root", "field").join(rooted.select("node", "root"), "node")
    fields = materialize(fields, "fields")

    sizes = fields.groupBy("field", "root").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("part", F.when(F.col("n") >= s.block, F.col("root")).otherwise(-1))
    parts = sizes.groupBy("field", "part").agg(F.ceil(F.sum("n") / s.block).cast("int").alias("blocks"))
    block = F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("block")
    nodes = fields.join(sizes.select("field", "root", "part"), ["field", "root"]).join(parts, ["field", "part"])
    nodes = nodes.select("field", "part", block, "node", "root")

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = parts.select("field", F.col("part").alias("p"), F.col("blocks").alias("m"))
    right = parts.select("field", F.col("part").alias("q"), F.col("blocks").alias("n"))
    among = parts.filter("part = -1").select("field", F.col("part").alias("p"), F.col("part").alias("q"), F.col("blocks").alias("m"), F.col("blocks").alias("n"))
    pairs = left.join(right, "field").filter("p < q").select("field", "p", "q", "m", "n").unionByName(among)
    pairs = pairs.withColumn("i", numbers("m")).withColumn("j", numbers("n")).filter("p < q or i <= j")
    task = ["field", "p", "i", "q", "j"]
    on_left = pairs.join(nodes.toDF("field", "p", "i", "node", "root"), ["field", "p", "i"])
    on_right = pairs.filter("p < q or i < j").join(nodes.toDF("field", "q", "j", "node", "root"), ["field", "q", "j"])
    groups = on_left.select(*task, "node", "root", F.lit(0).alias("side"))
    groups = groups.unionByName(on_right.select(*task, "node", "root", F.lit(1).alias("side")))
    groups = groups.join(texts, "node").groupBy(*task)
    return materialize(groups.applyInPandas(_across(s), _LINK), "links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``df``.

    Rows are linked where 100 * common >= ``percent`` * all shingles of the two. ``component_id`` is
    the smallest doc_id that links lead to, and ``kept`` says whether it is the row's own; rows
    without a doc_id are kept if their component has none.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), *_identity(text_col), F.col(text_col).alias("text"))
    sets = materialize(rows.mapInArrow(*_sketched(s, rows.schema["doc_id"].dataType.simpleString())), "sets")

    chosen = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "h1", "h2")).alias("chosen")
    classes = sets.filter("n > 0").groupBy("s1", "s2").agg(chosen, F.first("sketch").alias("sketch"))
    classes = classes.select("s1", "s2", "chosen.doc_id", "chosen.h1", "chosen.h2", "sketch")
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    members = classes.select("node", "sketch").mapInArrow(_banded(s), "node long, key long")
    buckets = members.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    members = materialize(members.join(buckets.select("key"), "key"), "members")
    buckets = members.groupBy("key").agg(F.min("node").alias("first"))

    # Only texts that share a bucket are compared. Of equal rows one text is taken, before any join.
    wanted = members.select("node").distinct().join(classes, "node")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("doc_id", "h1", "h2")]
    one_each = rows.groupBy("doc_id", "h1", "h2").agg(F.first("text").alias("text"))
    texts = one_each.alias("t").join(wanted.alias("w"), same).select("node", "sketch", "text")
    texts = materialize(texts, "texts")

    nodes = classes.select("s1", "s2", "node", "doc_id")
    links = _first_links(members, buckets, texts, s)
    links = links.unionByName(_other_links(members, buckets, _rooted(nodes, links), texts, s))
    named = _rooted(nodes, links)
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = materialize(named.join(ids, "root").select("s1", "s2", "component_id"), "named")

    found = sets.select("doc_id", "s1", "s2", "n").join(named.withColumn("known", F.lit(True)), ["s1", "s2"], "left")
    # Rows without shingles are in no class.
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )
