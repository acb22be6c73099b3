"""Similarity join of texts by the Jaccard similarity of their word shingles.

Method. Equal texts are one class. The MinHash values of each class are cut into bands;
classes that agree in a band are joined in a star around the smallest of them, and the
components of these stars hold all pairs that may be similar. Within a component the
MinHash values of two texts are compared a slice at a time; a pair is dropped as soon as
the posterior probability that its similarity reaches the threshold, given the agreements
so far, falls below ``tolerance`` (uniform prior, so a beta distribution). Pairs that
survive are verified exactly on their shingle sets. Components with many texts are cut
into blocks, and each pair of blocks is a group of its own; a group returns one row per
text with its number of links and the root of its links, so pairs are never listed.

Results. One row per document row: ``class_id`` is the smallest doc_id among the texts
connected by links, ``text_id`` the smallest doc_id with an equal text, ``n_links`` the
number of other texts that are similar enough, ``n_copies`` the number of rows with an
equal text. Words are separated by ASCII white space. A text of one to four words is one
shingle; a text without words has no links. A null text is an empty one. Rows with a null
doc_id are compared like others and never give an id, unless all ids of a class are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, int_lists, materialize, pieces, texts
from .graph import components


@dataclass(frozen=True)
class Settings:
    """``bands`` of ``rows`` MinHash values find a pair at the threshold of 0.8 with a
    probability of 1 - (1 - 0.8^6)^40, which misses five in a million, and fewer above it."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 40
    rows: int = 6
    tolerance: float = 1e-6
    step: int = 24
    block: int = 512

    @property
    def size(self) -> int:
        return self.bands * self.rows


# Shingles and MinHash ---------------------------------------------------------

_WORD_HASHES: dict[bytes, int] = {}
_WORD_MEMORY = 1 << 18


def _hashes(words: list[bytes]) -> np.ndarray:
    known = _WORD_HASHES
    found = [known.get(w) for w in words]
    if None in found:
        if len(known) > _WORD_MEMORY:
            known.clear()
        for k, h in enumerate(found):
            if h is None:
                known[words[k]] = found[k] = xxhash.xxh64_intdigest(words[k])
    return np.array(found, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """32-bit hashes of the shingles of a text, with repeats."""
    words = _hashes(text.encode().split())
    if not len(words):
        return np.empty(0, np.uint32)
    if len(words) < width:
        words = np.concatenate([words, np.zeros(width - len(words), np.uint64)])
    n = len(words) - width + 1
    mixed = words[:n].copy()
    for k in range(1, width):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += words[k : k + n]
    return (_mix(mixed) >> np.uint64(32)).astype(np.uint32)


@lru_cache(maxsize=4)
def _factors(size: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20_240_901)
    draw = lambda: random.integers(0, 1 << 32, size, np.uint32)[:, None]
    return draw() | np.uint32(1), draw()


def min_hashes(shingles: np.ndarray, size: int) -> np.ndarray:
    """The smallest value of each of ``size`` hash functions over a text's shingles."""
    factor, shift = _factors(size)
    found = np.full(size, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(shingles), 1024):
        values = shingles[None, start : start + 1024] * factor
        values += shift
        np.minimum(found, values.min(axis=1), out=found)
    return found


def band_keys(signature: np.ndarray, s: Settings) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    rows = signature.reshape(s.bands, s.rows).astype(np.uint64)
    keys = np.arange(1, s.bands + 1, dtype=np.uint64)
    for k in range(s.rows):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return keys.view(np.int64)


def _keys_of_batches(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                keys = []
                for text in texts(batch.column(3)):
                    shingles = shingle_hashes(text, s.words)
                    keys.append(band_keys(min_hashes(shingles, s.size), s) if len(shingles) else shingles)
                lists = int_lists(np.concatenate([*keys, []]).astype(np.int64), map(len, keys))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["h1", "h2", "doc_id", "keys"])
        # The worker may go on with another operator.
        _WORD_HASHES.clear()

    return run


# Bayesian pruning -------------------------------------------------------------


@lru_cache(maxsize=256)
def least_agreements(n: int, threshold: float, tolerance: float) -> int:
    """The fewest of ``n`` agreements that leave a posterior of at least ``tolerance``.

    With a uniform prior the similarity is beta distributed after m agreements, and the
    probability that it exceeds t is that of at most m successes in n + 1 trials of t.
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def surviving(left: np.ndarray, right: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], s: Settings):
    """The pairs (rows of ``left``, rows of ``right``) that no slice of values rules out."""
    i, j = pairs
    agreed = np.zeros(len(i), np.int32)
    for start in range(0, s.size, s.step):
        for part in range(0, len(i), 1 << 15):
            k = slice(part, part + (1 << 15))
            agreed[k] += (left[i[k], start : start + s.step] == right[j[k], start : start + s.step]).sum(1)
        keep = agreed >= least_agreements(min(start + s.step, s.size), s.threshold, s.tolerance)
        i, j, agreed = i[keep], j[keep], agreed[keep]
    return i, j


# Exact verification -----------------------------------------------------------


def exact_sets(members: list[str], width: int) -> list[np.ndarray]:
    """Shingle sets as numbers that are equal only for equal word sequences."""
    numbers: dict[bytes, int] = {}
    words, sizes = [], []
    for text in members:
        found = [numbers.setdefault(w, len(numbers) + 1) for w in text.encode().split()]
        if found:
            found += [0] * max(0, width - len(found))
        words += found
        sizes.append(len(found))
    ids = np.array(words, np.int64)
    ends = np.cumsum([0, *sizes])
    codes, base = ids.copy(), int(ids.max(initial=0)) + 1
    for k in range(1, width):
        following = np.zeros_like(ids)
        following[: len(ids) - k] = ids[k:]
        codes = np.unique(codes * base + following, return_inverse=True)[1].reshape(-1)
    return [np.unique(codes[a : max(a, b - width + 1)]) for a, b in zip(ends, ends[1:])]


def linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair of sets has the similarity asked for."""
    sizes = np.array([len(x) for x in sets])
    top = max((int(x[-1]) for x in sets if len(x)), default=0)
    inside = np.zeros(top + 1, bool)
    found = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        if not len(rows):
            continue
        own = sets[i[rows[0]]]
        inside[own] = True
        for row in rows:
            other = sets[j[row]]
            common = int(inside[other].sum())
            found[row] = common > 0 and common / (len(own) + sizes[j[row]] - common) >= threshold
        inside[own] = False
    return found


def _verify(s: Settings):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node", ignore_index=True)
        node, block = group["node"].to_numpy(), group["block"].to_numpy()
        members = [text or "" for text in group["text"]]
        signatures = np.stack([min_hashes(shingle_hashes(text, s.words), s.size) for text in members])
        if block.min() == block.max():
            pairs = np.triu_indices(len(node), 1)
        else:
            first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
            pairs = np.repeat(first, len(second)), np.tile(second, len(first))
        if group["a"].iloc[0] != group["b"].iloc[0] and block.min() == block.max():
            pairs = np.empty(0, np.int64), np.empty(0, np.int64)
        i, j = surviving(signatures, signatures, pairs, s)
        hit = linked(exact_sets(members, s.words), i, j, s.threshold)
        i, j = i[hit], j[hit]
        root = np.arange(len(node))
        while True:
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
            if (root == before).all():
                break
        links = np.bincount(i, minlength=len(node)) + np.bincount(j, minlength=len(node))
        return pd.DataFrame({"node": node, "root": node[root], "links": links})

    return run


# The join ---------------------------------------------------------------------


def _identity(text: str | Column) -> list[Column]:
    """128 bits that tell texts apart."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def text_classes(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(h1, h2, root, text_id, n_links, n_copies) of every distinct text of ``rows`` (h1, h2, doc_id, text).

    Texts of one class have the same ``root``.
    """
    id_type = rows.schema["doc_id"].dataType.simpleString()

    keyed = rows.mapInArrow(_keys_of_batches(s), f"h1 long, h2 long, doc_id {id_type}, keys array<bigint>")
    classes = keyed.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("text_id"), F.count("*").alias("n_copies"), F.first("keys").alias("keys")
    )
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    members = classes.select("node", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    stars = members.join(buckets, "key").filter("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    candidates = components(stars)
    # One row per candidate, so the counts of components are small next to the texts.
    candidates = materialize(candidates, "candidates")
    sizes = candidates.groupBy("root").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))
    placed = (
        candidates.join(sizes, "root")
        .join(classes.select("node", "h1", "h2", "text_id"), "node")
        .select("h1", "h2", "text_id", "node", "root", "blocks", F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("block"))
    )
    # One row of each class is compared, the one that gave the class its id.
    chosen = rows.withColumn("text_id", F.col("doc_id"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("h1", "h2", "text_id")]
    with_text = chosen.alias("r").join(placed.alias("p"), same).select("node", "text", "root", "blocks", "block")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = with_text.select("node", "text", "root", "block", other).select(
        "node", "text", "root", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")
    )
    verified = materialize(
        paired.groupBy("root", "a", "b").applyInPandas(_verify(s), "node long, root long, links long"), "verified"
    )

    links = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    groups = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("node", "h1", "h2", "text_id", "n_copies").join(links, "node", "left")
    named = named.join(groups, "node", "left").select(
        "h1", "h2", F.coalesce("root", "node").alias("root"), "text_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"
    )
    return materialize(named, "named")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(*_identity(F.col(text_col)), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def similar_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, text_id, n_links, n_copies), one row per row of ``df``."""
    rows = _rows(df, id_col, text_col)
    named = text_classes(rows, s)
    ids = named.groupBy("root").agg(F.min("text_id").alias("class_id"))
    named = named.join(ids, "root").select("h1", "h2", "class_id", "text_id", "n_links", "n_copies")
    return rows.select("h1", "h2", "doc_id").join(named, ["h1", "h2"]).drop("h1", "h2")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each class the row with the smallest id.

    A null id counts as smallest, and of rows with one id the text with the smallest hash
    stays; of rows with equal id and text it is the first by the other columns.
    """
    rows = _rows(df, id_col, text_col).select("h1", "h2", "doc_id")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h1", "h2")
    least = rows.join(text_classes(_rows(df, id_col, text_col), s), ["h1", "h2"]).groupBy("root").agg(F.min(place).alias("p"))
    # Plain keys, so that the join and the numbering share one shuffle.
    keys = [fresh(df, name) for name in ("_h1", "_h2", "_known", "_id")]
    number = fresh(df, "_number")
    key_of = lambda known, ident, h1, h2: [
        c.alias(k) for k, c in zip(keys, (h1, h2, known, F.when(known, ident.cast("string")).otherwise("")))
    ]
    wanted = least.select(*key_of(F.col("p.known"), F.col("p.doc_id"), F.col("p.h1"), F.col("p.h2")))
    own = key_of(F.col(id_col).isNotNull(), F.col(id_col), *_identity(F.col(text_col)))
    order = [F.asc_nulls_first(c) for c in df.columns if c not in (id_col, text_col)] or [F.lit(0)]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    found = df.select("*", *own).join(wanted, keys).withColumn(number, first)
    return found.filter(F.col(number) == 1).select(*[df[c] for c in df.columns])
