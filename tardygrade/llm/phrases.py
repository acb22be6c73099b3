"""Phrases of two to four words that occur together more often than their parts would suggest.

Method. Words that are frequent enough get ids by frequency rank, so that frequent pairs of ids
crowd into few tiles of the plane of pairs. A task counts its occurrences tile by tile: a tile
with many of them is a dense array addressed by the pair itself (``numpy.bincount``), the
occurrences of all other tiles are sorted coordinates with counts. Spark adds up the counts per
pair. Frequent pairs are ranked again and take the place of the left word, so pairs with one
more word give phrases of three words, and these give phrases of four: a phrase can only be
frequent if the phrases without its first and without its last word are.

Tables that tasks look ids up in are broadcast in blocks of ``block`` rows; a larger table takes
one pass over the coded texts for each block. Nothing else is broadcast, and nothing is
collected but these blocks. Steps that follow each other (hashing, looking up, counting) are one
function, since each function of a plan has a Python process of its own for each running task.

Results. Per language (null: ``und``) the ``top`` phrases by score, as described at
``collocations``. Letters A-Z are lower-cased, ``.,;:!?`` and line ends (bytes 10 to 13)
separate pieces, blanks and tabs separate words; phrases stay within pieces. Null and empty
texts have no words; repeated rows count as often as they are there; equal scores are ordered
by frequency and then by phrase, so ties have one order. Texts of any length are read in
parts cut between words. Further columns are not looked at. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pieces, strings
from .wordhash import mixed, windows, word_hashes


@dataclass(frozen=True)
class Settings:
    """``tile`` and ``grid`` are powers of two in bits: tiles have ``2**tile`` ids on each side, and
    the first ``2**grid`` rows and columns of tiles may be dense. ``dense`` is the number of
    occurrences from which a tile is counted in an array, ``buffer`` how many a task holds."""

    least: int = 30
    longest: int = 4
    share: int = 80
    top: int = 2000
    tile: int = 9
    grid: int = 6
    dense: int = 1 << 14
    buffer: int = 1 << 19
    block: int = 1 << 22


# Words ------------------------------------------------------------------------

_LINE, _BLANK, _NONE = 10, 32, -1
# A-Z in lower case, piece separators as line ends, tabs as blanks.
_PLAIN = bytes(
    _LINE if i in b".,;:!?\n\x0b\x0c\r" else _BLANK if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256)
)


@dataclass
class Words:
    """The words of a part of some texts: hashes, places in ``raw`` and whether a piece ends before each."""

    raw: bytes
    hashes: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    breaks: np.ndarray

    @staticmethod
    def of(raw: bytes, salt: int) -> Words:
        hashes, start, stop = word_hashes(raw)
        lines = np.cumsum(np.frombuffer(raw, np.uint8) == _LINE)[start]
        return Words(raw, mixed(hashes + np.uint64(salt)).view(np.int64), start, stop, np.diff(lines, prepend=0) > 0)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[Words]]]:
    """The texts of some rows (lang, text) by language, as words."""
    for whole in batches:
        for batch in pieces(whole):
            found: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    found.setdefault(lang, []).append(text.encode().translate(_PLAIN))
            for lang, texts in found.items():
                salt = xxhash.xxh64_intdigest(lang.encode())
                # Each text begins a piece.
                yield lang, (Words.of(part, salt) for _, part in windows(b"\n" + b"\n".join(texts)))


_COUNTED = "lang string, word string, hash long, n long"


def _word_counts():
    """Counts of the words of each task, and of all words of a language under a null word."""

    def rows(lang: str, words: list, hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = [strings([lang] * len(words)), strings(words), pa.array(hashes, pa.int64()), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "hash", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, parts in _by_language(batches):
            total = 0
            for part in parts:
                total += len(part.hashes)
                hashes, first, counts = np.unique(part.hashes, return_index=True, return_counts=True)
                places = zip(part.start[first].tolist(), part.stop[first].tolist())
                yield rows(lang, [part.raw[a:b].decode() for a, b in places], hashes, counts)
            yield rows(lang, [None], np.zeros(1, np.int64), np.array([total]))

    return run


# Ranks and lookups ------------------------------------------------------------


def _ranked(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``df`` with ``id``, its place in the given order from 0 on, without a window over all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("at", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    # One row for each partition.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"))
    offsets = sizes.select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    ranked = placed.join(offsets, "part").withColumn("id", F.col("offset") + F.col("at"))
    return materialize(ranked.drop("part", "at", "offset"), label)


class Lookup:
    """Ids by key for a block of a table."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order].astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The id of each key, -1 for none."""
        if not len(self.keys):
            return np.full(len(keys), _NONE, np.int32)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.ids[place], np.int32(_NONE))


def _blocks(table: DataFrame, key: Column, s: Settings) -> Iterator:
    """Broadcast lookups of ``table``, ``s.block`` rows at a time; an empty one for an empty table."""
    context = table.sparkSession.sparkContext
    rows = table.count()
    for start in range(0, max(rows, 1), s.block):
        part = table.filter(F.col("id").between(start, start + s.block - 1)).select(key.alias("key"), "id").toArrow()
        yield context.broadcast(Lookup(part.column("key").to_numpy(), part.column("id").to_numpy()))


def _packed(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _unpacked(value: pa.Scalar, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


# Coded texts ------------------------------------------------------------------

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _hashed():
    """The texts of each task as sequences of word hashes; 0 stands for the end of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _by_language(batches):
            # A piece may go on from one window to the next, so they are put together again.
            found = [np.insert(part.hashes, np.flatnonzero(part.breaks), 0) for part in parts]
            yield pa.RecordBatch.from_arrays([_packed([np.concatenate(found)])], names=["hashes"])

    return run


@dataclass(frozen=True)
class Texts:
    """A table and the steps that its rows still have to go through, one after another in one process."""

    table: DataFrame
    steps: tuple[Step, ...] = ()

    def then(self, step: Step) -> Texts:
        return Texts(self.table, (*self.steps, step))

    def rows(self, kind: str) -> DataFrame:
        """The table after its steps; ``kind`` names its columns and types."""
        steps = self.steps

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for step in steps:
                batches = step(batches)
            return batches

        return self.table.mapInArrow(run, kind) if steps else self.table


def _renamed(columns: dict[str, str]) -> Step:
    """Some columns by their new names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(name) for name in columns], names=list(columns.values()))

    return run


def _looked_up(texts: Texts, names: list[str], phrases: DataFrame, key: Column, keys_of, s: Settings) -> Texts:
    """``texts`` (binary columns ``names``) with ``found``: the id of what begins at each word, -1 for none.

    ``keys_of`` gives the places of a row that have a key, the keys and the length of the row.
    Every block of ``phrases`` is a pass of its own; with more than one, each is written.
    """

    def fill(block, again: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = block.value
            for batch in batches:
                for k in range(batch.num_rows):
                    at, keys, size = keys_of(*[batch.column(c)[k] for c in range(len(names))])
                    found = np.full(size, _NONE, np.int32)
                    found[at] = look(keys)
                    if again:
                        found = np.maximum(found, _unpacked(batch.column(len(names))[k]))
                    columns = [batch.column(c).slice(k, 1) for c in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*columns, _packed([found])], names=[*names, "found"])

        return run

    kind = ", ".join(f"{name} binary" for name in [*names, "found"])
    several = phrases.count() > s.block
    for n, block in enumerate(_blocks(phrases, key, s)):
        texts = texts.then(fill(block, n > 0))
        if several:
            texts = Texts(materialize(texts.rows(kind), "coded"))
    return texts


def _coded(docs: DataFrame, words: DataFrame, s: Settings) -> Texts:
    """The texts as sequences of word ids, written once; -1 stands for an infrequent word and for the end of a piece.

    Rows have them twice: as ``words`` and, as phrases of one word, as ``left``.
    """

    def keys_of(hashes: pa.Scalar):
        keys = _unpacked(hashes, np.int64)
        return np.arange(len(keys)), keys, len(keys)

    texts = _looked_up(Texts(docs, (_hashed(),)), ["hashes"], words, F.col("hash"), keys_of, s)
    coded = texts.then(_renamed({"found": "words"})).rows("words binary")
    return Texts(materialize(coded, "coded").withColumn("left", F.col("words")))


def _with_left(texts: Texts, phrases: DataFrame, reach: int, s: Settings) -> Texts:
    """``texts`` (words, left) with the ids of phrases that are one word longer as ``left``.

    ``phrases`` (id, left, right) has their ids; the last word is ``reach`` words behind the first.
    """

    def keys_of(words: pa.Scalar, left: pa.Scalar):
        words, left = _unpacked(words), _unpacked(left)
        at = np.flatnonzero((left[: max(0, len(words) - reach)] >= 0) & (words[reach:] >= 0))
        return at, left[at].astype(np.int64) << 32 | words[at + reach], len(words)

    key = F.shiftleft(F.col("left"), 32).bitwiseOR(F.col("right"))
    return _looked_up(texts, ["words", "left"], phrases, key, keys_of, s).then(_renamed({"words": "words", "found": "left"}))


# Counting ---------------------------------------------------------------------


def tile_counts(codes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes (left id << 32 | right id) with their numbers.

    Tiles near the origin that hold ``s.dense`` codes or more are dense arrays; all others
    are counted as sorted coordinates.
    """
    left, right = codes >> 32, codes & 0xFFFFFFFF
    near = np.flatnonzero((left | right) < 1 << (s.tile + s.grid))
    tile = (left[near] >> s.tile << s.grid | right[near] >> s.tile).astype(np.uint16)
    crowded = np.bincount(tile, minlength=1 << 2 * s.grid) >= s.dense
    inside = crowded[tile]
    near, tile = near[inside], tile[inside]
    sparse = np.ones(len(codes), bool)
    sparse[near] = False
    keys, counts = map(list, zip(np.unique(codes[sparse], return_counts=True)))
    order = np.argsort(tile, kind="stable")
    mask, ends = (1 << s.tile) - 1, np.cumsum(np.bincount(tile, minlength=len(crowded)))
    for t in np.flatnonzero(crowded):
        own = near[order[ends[t - 1] if t else 0 : ends[t]]]
        cells = np.bincount((left[own] & mask) << s.tile | (right[own] & mask), minlength=1 << 2 * s.tile)
        cell = np.flatnonzero(cells)
        row = (int(t) >> s.grid << s.tile) + (cell >> s.tile)
        column = ((int(t) & (1 << s.grid) - 1) << s.tile) + (cell & mask)
        keys.append(row << 32 | column)
        counts.append(cells[cell])
    return np.concatenate(keys), np.concatenate(counts)


def _pair_counts(size: int, s: Settings):
    """Counts of the phrases of ``size`` words in each task: id of all but the last word, id of the last."""

    def rows(codes: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = tile_counts(np.concatenate(codes), s)
        columns = [pa.array(keys >> 32, pa.int64()), pa.array(keys & 0xFFFFFFFF, pa.int64()), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["left", "right", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, codes = 0, []
        for batch in batches:
            for k in range(batch.num_rows):
                words, left = _unpacked(batch.column(0)[k]), _unpacked(batch.column(1)[k])
                reach = size - 1
                starts = max(0, len(words) - reach)
                known = (left[:starts] >= 0) & (words[reach:] >= 0)
                if size > 2:
                    known &= left[1 : starts + 1] >= 0
                at = np.flatnonzero(known)
                for start in range(0, len(at), s.buffer):
                    own = at[start : start + s.buffer]
                    codes.append(left[own].astype(np.int64) << 32 | words[own + reach])
                    held += len(own)
                    if held >= s.buffer:
                        yield rows(codes)
                        held, codes = 0, []
        if held:
            yield rows(codes)

    return run


def _frequent(texts: Texts, size: int, s: Settings) -> DataFrame:
    """(left, right, a, id): the phrases of ``size`` words that are frequent, ranked."""
    counts = texts.then(_pair_counts(size, s)).rows("left long, right long, n long")
    counts = counts.groupBy("left", "right").agg(F.sum("n").alias("a")).filter(F.col("a") >= s.least)
    return _ranked(counts, [F.desc("a"), F.asc("left"), F.asc("right")], f"phrases{size}")


# Scores -----------------------------------------------------------------------


def _cut(k: int, left: str, right: str) -> Column:
    """Score of a cut after ``k`` words. Products may pass 64 bits, so they are decimals."""
    score = F.expr(f"(cast(a as decimal(20, 0)) * 2000000) div (cast({left} as decimal(20, 0)) + {right})")
    return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))


def _named(size: int, frequent: DataFrame, tables: dict[int, DataFrame]) -> DataFrame:
    """Phrases of ``size`` words with their words, text, the numbers of their parts and the cut that counts.

    ``f{i}{j}`` is the number of the part from word i to word j; ``first`` and ``last`` are the
    ids of the phrases without the last and without the first word.
    """
    before = tables[size - 1]
    keep = ["lang", *[f"w{i}" for i in range(1, size)], *[c for c in before.columns if c[0] == "f" and c[1:].isdigit()]]
    first = before.select(F.col("id").alias("first"), F.col("phrase").alias("start"), *keep)
    word = tables[1].select(F.col("id").alias(f"w{size}"), F.col("phrase").alias("end"), F.col("a").alias(f"f{size}{size}"))
    table = (
        frequent.withColumnRenamed("left", "first")
        .withColumnRenamed("right", f"w{size}")
        .join(first, "first")
        .join(word, f"w{size}")
        .withColumn("phrase", F.concat_ws(" ", "start", "end"))
        .withColumn(f"f1{size}", F.col("a"))
    )
    # Parts that end with the last word; the longest of them is the phrase without the first word.
    for begin in range(2, size):
        length = size - begin + 1
        names = {f"w{i}": f"w{begin + i - 1}" for i in range(1, length + 1)}
        part = tables[length].select(
            F.col("id").alias("last" if begin == 2 else "other"), F.col("a").alias(f"f{begin}{size}"), *[F.col(a).alias(b) for a, b in names.items()]
        )
        table = table.join(part, list(names.values()))
    if size == 2:
        table = table.withColumn("last", F.col("w2"))
    cuts = [_cut(k, f"f1{k}", f"f{k + 1}{size}") for k in range(1, size)]
    best = F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]
    return materialize(table.drop("start", "end", "other").withColumn("best", best), f"named{size}")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language.

    ``a`` is the number of occurrences of the phrase, ``n`` that of all words of the language.
    A cut after k words has the score floor(2000000 * a / (l + r)), with the numbers ``l`` and
    ``r`` of the two parts; the lowest score counts, and of equal ones the first. A phrase
    that is part of a longer one with at least ``share`` percent of its occurrences is left out.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_word_counts(), _COUNTED).groupBy("lang", "word", "hash").agg(F.sum("n").alias("a"))
    counted = materialize(counted.filter((F.col("a") >= s.least) | F.col("word").isNull()), "words")
    totals = counted.filter("word IS NULL").select("lang", F.col("a").alias("n"))
    words = _ranked(counted.filter("word IS NOT NULL"), [F.desc("a"), F.asc("lang"), F.asc("word")], "words")

    texts = _coded(rows, words, s)
    tables = {1: words.select("id", "lang", F.col("word").alias("phrase"), "a", F.col("id").alias("w1"), F.col("a").alias("f11"))}
    scored = []
    for size in range(2, s.longest + 1):
        frequent = _frequent(texts, size, s)
        tables[size] = _named(size, frequent, tables)
        if size < s.longest:
            texts = _with_left(texts, frequent, size - 1, s)

    for size in range(2, s.longest + 1):
        table = tables[size].select("id", "lang", "phrase", "a", "best.l", "best.r", "best.score")
        if size < s.longest:
            # A phrase is in no longer one more often than in one with a single word more.
            longer = tables[size + 1].select(F.explode(F.array("first", "last")).alias("id"), F.col("a").alias("longer"))
            longer = longer.groupBy("id").agg(F.max("longer").alias("longer"))
            covered = F.coalesce(F.col("longer") * 100 >= F.col("a") * s.share, F.lit(False))
            table = table.join(longer, "id", "left").filter(~covered).drop("longer")
        scored.append(table.drop("id"))
    found = scored[0]
    for table in scored[1:]:
        found = found.unionByName(table)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= s.top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
