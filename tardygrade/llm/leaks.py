"""Documents that contain benchmark passages, also reworded ones.

Method. Texts are cut into overlapping passages of words. Hashed terms are weighted by TF-IDF
with frequencies of the whole corpus, and a randomised singular value decomposition of all
passages gives a latent space: each product with the passage matrix is one pass in which
every partition adds up its share, and only matrices of terms by dimensions are combined.
Passages and the passages of the benchmark items are compared by cosine in that space, with
all directions scaled alike. Each candidate is then checked on its words: the longest common
subsequence of the item and the surrounding text must hold ``least_common`` of the item, and
``least_answer`` of the item's answer, its last sentence.

Results. One row per (document, text, item) that passes: doc_id, item_id, cosine of the best
passage, the two shares, the place of the match in words, and ``h1`` and ``h2``, the 128 bits
that tell the text from others of the same id or of none. Repeated rows of a document give
one row. Null texts are empty; empty texts and items never match. Rows with a null id are
searched like others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, int_lists, materialize, pieces, texts


@dataclass(frozen=True)
class Settings:
    """A passage is ``blocks`` blocks of ``block`` words and starts at every block.

    ``least_cosine`` only chooses candidates and is low, as the words decide.
    ``items`` and ``item_bytes`` bound the benchmark items that are searched for, and broadcast, at
    a time; ``beside`` of them are compared with some texts at once.
    """

    block: int = 8
    blocks: int = 3
    terms: int = 1 << 13
    dimensions: int = 88
    oversampling: int = 8
    least_cosine: float = 0.3
    least_common: float = 0.6
    least_answer: float = 0.5
    items: int = 20_000
    item_bytes: int = 16 << 20
    beside: int = 128
    seed: int = 11


SIGNS = b".,;:!?\"'()[]{}*%$&#|<>-_"

# Words ------------------------------------------------------------------------

# White space as blanks.
_WHITE = b" \t\n\x0b\x0c\r"
_SPACED = bytes(32 if i in _WHITE else i for i in range(256))
_RANDOM = np.random.default_rng(77).integers(0, 1 << 64, (2, 1024), np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def hashed_words(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words of some texts, one after the other, and their number in each text.

    Words are compared without case and without ``SIGNS``, wherever they stand;
    bare signs are no words. A word's hash is a sum over its bytes, each weighted by its
    place in the word, so all words are hashed at once.
    """
    parts = [line.lower().encode().translate(_SPACED, SIGNS) for line in lines]
    # Some texts at a time, so that their bytes' hashes stay in the processor's cache.
    size = np.cumsum([len(part) for part in parts]) >> 16
    edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(parts)]
    found = [_hashed(parts[a:z]) for a, z in zip(edges, edges[1:])]
    return tuple(np.concatenate(x) for x in zip(*found))


def _hashed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for some texts in lower case, with blanks as their only white space and without signs."""
    raw = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    inside = raw != 32
    start = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    if not len(start):
        return np.empty(0, np.int32), np.zeros(len(parts), np.int64)
    at = np.flatnonzero(inside)
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    value = _RANDOM[0, raw[at]] * _RANDOM[1, place & 1023]
    hashes = (_mixed(np.add.reduceat(value, first)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    ends = np.cumsum([len(part) + 1 for part in parts])
    return hashes, np.diff(np.r_[0, np.searchsorted(start, ends)])


def word_hashes(text: str) -> list[int]:
    return hashed_words([text])[0].tolist()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole):
            hashes, sizes = hashed_words(texts(batch.column(1)))
            columns = [batch.column(0), int_lists(hashes, sizes), batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "words", "h1", "h2"])


# Passages ---------------------------------------------------------------------


class Passages:
    """The passages of some texts: terms by block, and blocks by passage."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, s: Settings):
        self.s = s
        per_text = -(-sizes // s.block)
        ends = np.cumsum(sizes)
        self.owner = np.repeat(np.arange(len(sizes)), per_text)
        number = np.arange(len(self.owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        self.word = number * s.block
        # Terms by block; places without a word have a term of their own.
        self.first = (ends - sizes)[self.owner] + self.word
        self.ends = np.cumsum(per_text)
        place = self.first[:, None] + np.arange(s.block)
        padded = np.append(words.astype(np.int64) % s.terms, s.terms)
        self.term = padded[np.where(place < ends[self.owner][:, None], place, len(words))]
        # A passage begins at every block; short ends stay with the last full passage.
        self.heads = np.flatnonzero((number == 0) | (number <= per_text[self.owner] - s.blocks))

    def counts(self) -> np.ndarray:
        return np.bincount(self.term.ravel(), minlength=self.s.terms + 1)[: self.s.terms]

    def _parts(self, some: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passages, blocks): the k-th block of all passages, or some of them, that have one, for each k."""
        heads = self.heads if some is None else self.heads[some]
        for k in range(self.s.blocks):
            at = heads + k
            inside = np.flatnonzero(at < self.ends[self.owner[heads]])
            yield inside, at[inside]

    def sums(self, of_term: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
        """Sum over the words of each passage, or of some of them, of a row per term."""
        table = np.concatenate([of_term, np.zeros((1, of_term.shape[1]), of_term.dtype)])
        needed = np.arange(len(self.term))
        if some is not None:
            head = self.heads[some]
            needed = np.unique(np.minimum(head[:, None] + np.arange(self.s.blocks), self.ends[self.owner[head]][:, None] - 1))
        blocks = np.zeros((len(needed), table.shape[1]), table.dtype)
        # Some blocks at a time, so that sums stay in the processor's cache.
        rows = np.empty((min(256, len(needed)), table.shape[1]), table.dtype)
        for start in range(0, len(needed), 256):
            part, terms = blocks[start : start + 256], self.term[needed[start : start + 256]].T
            for k in range(self.s.block):
                part += table.take(terms[k], axis=0, out=rows[: len(part)], mode="clip")
        chosen = np.arange(len(self.heads)) if some is None else some
        total = np.zeros((len(chosen), table.shape[1]), table.dtype)
        for passages, own in self._parts(chosen):
            total[passages] += blocks[own if some is None else np.searchsorted(needed, own)]
        return total

    def spread(self, of_passage: np.ndarray) -> np.ndarray:
        """Sum over the passages with each term (as often as it is there) of a row per passage."""
        blocks = np.zeros((len(self.term), of_passage.shape[1]), of_passage.dtype)
        for passages, own in self._parts():
            blocks[own] += of_passage[passages]
        # One place of all blocks at a time, so that no row is repeated for the words of its block.
        size, places = self.s.terms + 1, np.ascontiguousarray(self.term.T)
        columns = np.ascontiguousarray(blocks.T, np.float64)
        sums = [sum(np.bincount(terms, row, minlength=size) for terms in places) for row in columns]
        return np.stack(sums, axis=1)[: self.s.terms]


def _each(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Passages]]:
    for whole in batches:
        for batch in pieces(whole):
            words = batch.column(1).flatten().to_numpy()
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy().astype(np.int64)
            yield batch, words, sizes, Passages(words, sizes, s)


# Sums over all passages -------------------------------------------------------

_PART = 256  # rows of a matrix in one message


def _added_up(tokens: DataFrame, shape: tuple[int, int], share, s: Settings) -> np.ndarray:
    """Sum over all partitions of the matrix that ``share`` gives for some passages.

    Partitions are added up in two steps, so that no task holds the matrices of all.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, _, _, passages in _each(batches, s):
            total += share(passages)
        rows = range(0, shape[0], _PART)
        salt = int(np.abs(total).sum() * 997) % 64
        columns = [
            pa.array([r // _PART for r in rows], pa.int32()),
            pa.array([salt] * len(rows), pa.int32()),
            pa.array([total[r : r + _PART].astype(np.float32).tobytes() for r in rows], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "salt", "matrix"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in group.column("matrix").to_pylist())
        total = total.astype(np.float32)
        columns = [group.column("part").slice(0, 1), group.column("salt").slice(0, 1), pa.array([total.tobytes()], pa.binary())]
        return pa.Table.from_arrays(columns, names=["part", "salt", "matrix"])

    kind = "part int, salt int, matrix binary"
    sums = tokens.mapInArrow(local, kind).groupBy("part", "salt").applyInArrow(add, kind)
    sums = sums.groupBy("part").applyInArrow(add, kind)
    parts = sorted((r["part"], r["matrix"]) for r in sums.collect())
    if not parts:
        return np.zeros(shape)
    return np.concatenate([np.frombuffer(m, np.float32) for _, m in parts]).reshape(shape).astype(np.float64)


@dataclass
class LatentSpace:
    """``weight`` maps a term, weighted by its inverse frequency, to scaled directions."""

    weight: np.ndarray
    s: Settings
    share: np.ndarray | None = None  # of each term among all words

    def vectors(self, passages: Passages, some: np.ndarray | None = None) -> np.ndarray:
        """Directions of the passages, or of some of them."""
        found = passages.sums(self.weight, some)
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def latent_space(tokens: DataFrame, s: Settings = Settings()) -> LatentSpace:
    """Randomised SVD of the TF-IDF matrix of all passages of ``tokens`` (doc_id, words)."""
    counts = _added_up(tokens, (s.terms, 1), lambda p: p.counts()[:, None], s)[:, 0]
    share = np.minimum((counts + 1) / (counts.sum() + s.terms), 0.999)
    idf = (-np.log(1 - (1 - share) ** (s.block * s.blocks)))[:, None]

    # One pass gives the image of a random sketch under the Gram matrix, a second one the Gram
    # matrix of all passages within that image; its eigenvectors are the directions.
    width = s.dimensions + s.oversampling
    sketch = np.linalg.qr(np.random.default_rng(s.seed).normal(size=(s.terms, width)))[0]
    start = (idf * sketch).astype(np.float32)
    image = idf * _added_up(tokens, (s.terms, width), lambda p: p.spread(p.sums(start)), s)
    basis = np.linalg.qr(image)[0]
    turned = (idf * basis).astype(np.float32)

    def gram(p: Passages) -> np.ndarray:
        rows = p.sums(turned)
        return (rows.T @ rows).astype(np.float64)

    value, vector = np.linalg.eigh(_added_up(tokens, (width, width), gram, s))
    # With about as many directions as passages, all passages would be at right angles, so a
    # small corpus has fewer directions; those that no passage has count nothing.
    order = np.argsort(-value)[: max(1, min(s.dimensions, int(counts.sum()) // (8 * s.block)))]
    there = value[order] > max(1e-6 * value.max(), 1e-12)
    scale = np.where(there, 1 / np.sqrt(np.where(there, value[order], 1)), 0)
    return LatentSpace((idf * (basis @ (vector[:, order] * scale))).astype(np.float32), s, share.astype(np.float32))


# Checks on words --------------------------------------------------------------


def common_words(left: list[int], right: list[int]) -> int:
    """Length of the longest common subsequence, bit by bit."""
    places: dict[int, int] = {}
    for k, w in enumerate(left):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(left)) - 1
    row = full
    for w in right:
        same = row & places.get(w, 0)
        row = ((row + same) | (row - same)) & full
    return len(left) - row.bit_count()


def answer_of(text: str) -> list[int]:
    """The last sentence of an item; the last third if that is all it has."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text) if word_hashes(s)]
    if len(sentences) > 1:
        return word_hashes(sentences[-1])
    words = word_hashes(text)
    return words[-max(1, -(-len(words) // 3)) :] if words else []


@dataclass
class Items:
    """Some benchmark items with the vectors of their passages and a bound on what texts have in common with them.

    Words in common are at most those of the item that are frequent in the corpus (``base``), all
    taken as found, and the words of the text that are other words of the item (``rare``, by word
    and item). Which words count as frequent only decides how sharp the bound is.
    """

    ids: list
    words: list[list[int]]
    answers: list[list[int]]
    owner: np.ndarray
    vectors: np.ndarray
    vocabulary: np.ndarray
    known: np.ndarray  # whether a word of the vocabulary has these last bits
    rare: tuple[np.ndarray, np.ndarray]  # items of each word, one after the other, and where they end
    base: np.ndarray
    sizes: np.ndarray
    reach: np.ndarray  # in blocks, to both sides of a passage
    width: int  # words in a block
    times: np.ndarray  # how often each item has each word of the vocabulary, and any other

    @staticmethod
    def of(rows: list[tuple], space: LatentSpace) -> Items:
        s = space.s
        words = [word_hashes(text) for _, text in rows]
        flat = np.array([w for x in words for w in x], np.int64)
        sizes = np.array([len(x) for x in words], np.int64)
        passages = Passages(flat, sizes, s)
        owner = passages.owner[passages.heads]
        vocabulary, number = np.unique(flat.astype(np.int32), return_inverse=True)
        counts = np.zeros((len(vocabulary), len(words)), np.int32)
        np.add.at(counts, (number, np.repeat(np.arange(len(words)), sizes)), 1)
        share = np.zeros(s.terms) if space.share is None else space.share
        region = 2 * (sizes + s.block) + s.block * s.blocks
        expected = share[vocabulary.astype(np.int64) % s.terms][:, None] * region
        frequent = 2 * expected >= np.maximum(counts, 1)
        base = np.where(frequent, counts, 0).sum(axis=0)
        of_word, of_item = np.nonzero((counts > 0) & ~frequent)
        known = np.zeros(1 << 16, bool)
        known[vocabulary & 0xFFFF] = True
        return Items(
            [r[0] for r in rows], words, [answer_of(t) for _, t in rows], owner, space.vectors(passages), vocabulary, known,
            (of_item, np.cumsum(np.bincount(of_word, minlength=len(vocabulary)))), base, sizes, -(-(sizes + s.block) // s.block), s.block,
            np.r_[counts, np.zeros((1, len(words)), np.int32)].T.copy(),
        )

    @staticmethod
    def some(rows: list[tuple], space: LatentSpace) -> list[Items]:
        """Items in groups of ``beside``, of like length; items without words are left out."""
        rows, size = [r for r in rows if r[1] and word_hashes(r[1])], space.s.beside
        rows.sort(key=lambda r: len(word_hashes(r[1])))
        return [Items.of(rows[k : k + size], space) for k in range(0, len(rows), size)]

    def numbered(self, words: np.ndarray) -> np.ndarray:
        """The place of each word in the vocabulary; its size for other words."""
        found = np.full(len(words), len(self.vocabulary), np.int32)
        at = np.flatnonzero(self.known[words & 0xFFFF])
        number = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
        inside = self.vocabulary[number] == words[at]
        found[at[inside]] = number[inside]
        return found

    def rare_words(self, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Running numbers of rare words before each block, a row for each item; blocks begin at ``first``."""
        items, ends = self.rare
        at = np.flatnonzero(np.diff(ends, prepend=0, append=ends[-1])[numbers])
        number = numbers[at]
        times = np.diff(ends, prepend=0)[number]
        # The items of each word found, one after the other.
        shift = np.repeat(ends[number] - np.cumsum(times), times)
        item = items[np.arange(times.sum()) + shift]
        block = np.repeat(np.searchsorted(first, at, "right"), times)
        shape = len(self.ids), len(first) + 1
        found = np.bincount(item * shape[1] + block, minlength=shape[0] * shape[1]).reshape(shape)
        # Differences of running numbers may wrap around, as long as they fit themselves.
        kind = np.uint16 if self.most < 1 << 16 else np.uint32
        return np.cumsum(found.astype(kind), axis=1, dtype=kind)

    @property
    def most(self) -> int:
        """Words in the widest region around a passage, taken twice as a margin."""
        return 2 * self.width * (2 * int(self.reach.max()) + 8)


HITS = "cosine double, common double, answer double, first_word int, last_word int, h1 long, h2 long"


def _candidates(words: np.ndarray, sizes: np.ndarray, passages: Passages, own: Items, space: LatentSpace) -> Iterator[tuple]:
    """(text, item, cosines, places) of pairs with passages that are near and may have enough words in common.

    Two bounds on words are the cheaper tests, so cosines are computed for places that pass them.
    The cosine of a place is that of the item's nearest passage.
    """
    s = space.s
    numbers = own.numbered(words)
    bounds, widest = np.r_[passages.first, len(words)], int(own.reach.max())
    least = np.maximum(np.ceil(s.least_common * own.sizes - own.base - 1e-9), 0)
    starts = np.r_[0, passages.ends[:-1]]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for k in range(0, len(passages.heads), 4096):
        head = passages.heads[k : k + 4096]
        text = passages.owner[head]
        # Blocks that these passages reach.
        low, high = max(0, int(head[0]) - widest), min(len(passages.first), int(head[-1]) + s.blocks + widest)
        before = own.rare_words(numbers[bounds[low] : bounds[high]], passages.first[low:high] - bounds[low])
        enough = np.empty((len(own.ids), len(head)), bool)
        for reach in np.unique(own.reach):
            # Items of one reach are next to each other.
            items = slice(*np.searchsorted(own.reach, [reach, reach + 1]))
            first = np.maximum(head - reach, starts[text]) - low
            last = np.minimum(head + s.blocks + reach, passages.ends[text]) - low
            own_before = before[items]
            in_reach = own_before.take(last, axis=1) - own_before.take(first, axis=1)
            enough[items] = in_reach >= least[items, None].astype(before.dtype)
        column, row = np.divmod(np.flatnonzero(enough), enough.shape[1])
        found.append((k + row, column))
    row, item = (np.concatenate(x) for x in zip(*found))
    text = passages.owner[passages.heads[row]]
    order = np.lexsort((item, text))
    row, item, text = row[order], item[order], text[order]
    place = passages.word[passages.heads[row]]
    keep = _enough_in_common(numbers, sizes, own, text, item, place, s)
    row, item, text, place = row[keep], item[keep], text[keep], place[keep]
    near, of_near = np.unique(row, return_inverse=True)
    vectors, cosine = space.vectors(passages, near), np.empty(len(row))
    first = np.searchsorted(own.owner, item)
    times = np.searchsorted(own.owner, item, "right") - first
    for k in range(0, len(row), 4096):
        some = slice(k, k + 4096)
        ends = np.cumsum(times[some])
        own_passage = np.arange(ends[-1]) + np.repeat(first[some] - (ends - times[some]), times[some])
        each = np.einsum("ij,ij->i", np.repeat(vectors[of_near[some]], times[some], axis=0), own.vectors[own_passage])
        cosine[some] = np.maximum.reduceat(each, ends - times[some])
    keep = cosine >= s.least_cosine
    text, item, cosine, place = text[keep], item[keep], cosine[keep], place[keep]
    edges = np.r_[0, np.flatnonzero(np.diff(text) | np.diff(item)) + 1, len(text)] if len(text) else []
    for a, z in zip(edges, edges[1:]):
        yield int(text[a]), int(item[a]), cosine[a:z], place[a:z]


def _search(space, items, id_kind: pa.DataType, item_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latent = space.value
        s = latent.s
        for batch, words, sizes, passages in _each(batches, latent.s):
            if not len(words):
                continue
            starts = np.cumsum(sizes) - sizes
            head_text, head_word = passages.owner[passages.heads], passages.word[passages.heads]
            ids, h1, h2 = (batch.column(k) for k in (0, 2, 3))
            rows = []
            for own in items.value:
                for text, item, *found in _candidates(words, sizes, passages, own, latent):
                    hit = _checked(words[starts[text] : starts[text] + sizes[text]], own, item, *found, s)
                    if hit:
                        # The best passage of the match, which need not be the one that led to its bounds.
                        inside = np.flatnonzero((head_text == text) & (head_word >= hit[2]) & (head_word < hit[3]))
                        cosine = float((latent.vectors(passages, inside) @ own.vectors[own.owner == item].T).max())
                        rows.append((ids[text].as_py(), own.ids[item], cosine, *hit, h1[text].as_py(), h2[text].as_py()))
            kinds = [id_kind, item_kind, *[pa.float64()] * 3, *[pa.int32()] * 2, *[pa.int64()] * 2]
            names = ["doc_id", "item_id", "cosine", "common", "answer", "first_word", "last_word", "h1", "h2"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return run


def _region(places: np.ndarray, text_size, item_size, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The words around passages that are compared with an item."""
    width = item_size + s.block
    return np.maximum(0, places - width), np.minimum(text_size, places + s.block * s.blocks + width)


def _enough_in_common(
    numbers: np.ndarray, sizes: np.ndarray, own: Items, text: np.ndarray, item: np.ndarray, places: np.ndarray, s: Settings
) -> np.ndarray:
    """Whether the region of each (text, item, place) has ``least_common`` of the item's words, each as often as both have it.

    This bounds the subsequence. Rows are in order of text and item. A word of a region counts if
    the item has it and fewer than the item's number of the same words stand before it in the region.
    """
    keep = np.zeros(len(text), bool)
    least = s.least_common * own.sizes
    low, high = _region(places, sizes[text], own.sizes[item], s)
    shift = (np.cumsum(sizes) - sizes)[text]
    low, high = low + shift, high + shift
    pair = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (np.diff(item) != 0)]) if len(text) else np.empty(0, np.int64)
    begin, end = (f.reduceat(x, pair) if len(pair) else x for f, x in ((np.minimum, low), (np.maximum, high)))
    of_pair = np.repeat(np.arange(len(pair)), np.diff(np.r_[pair, len(text)]))
    # As many pairs at a time as have some hundred thousand words.
    part = np.cumsum(end - begin) >> 18
    for chosen in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(part)) + 1) if len(pair) else ():
        spans = (end - begin)[chosen]
        at = np.arange(spans.sum()) + np.repeat(begin[chosen] - (np.cumsum(spans) - spans), spans)
        times = own.times[np.repeat(item[pair[chosen]], spans), numbers[at]]
        there = np.flatnonzero(times)
        at, times = at[there], times[there]
        group = np.repeat(np.arange(len(chosen)), spans)[there]
        # For each word found, the place of the one that it would displace.
        key = group * np.int64(len(own.vocabulary) + 1) + numbers[at]
        order = np.argsort(key, kind="stable")
        ahead = np.arange(len(at)) - times[order]
        same = (ahead >= 0) & (key[order] == key[order][np.maximum(ahead, 0)])
        displaced = np.full(len(at), -1)
        displaced[order] = np.where(same, at[order][np.maximum(ahead, 0)], -1)
        rows = slice(pair[chosen[0]], pair[chosen[-1] + 1] if chosen[-1] + 1 < len(pair) else len(text))
        # The words found in each region, one after the other.
        place = group * np.int64(len(numbers) + 1) + at
        base = (of_pair[rows] - chosen[0]) * np.int64(len(numbers) + 1)
        first, last = np.searchsorted(place, base + low[rows]), np.searchsorted(place, base + high[rows])
        for k in range(0, len(first), 4096):
            some = slice(k, k + 4096)
            inside = last[some] - first[some]
            found = np.arange(inside.sum()) + np.repeat(first[some] - (np.cumsum(inside) - inside), inside)
            counts = displaced[found] < np.repeat(low[rows][some], inside)
            total = np.r_[0, np.cumsum(counts)]
            ends = np.cumsum(inside)
            keep[rows][some] = total[ends] - total[ends - inside] >= least[item[rows][some]]
    return keep


def _checked(words: np.ndarray, items: Items, item: int, cosines: np.ndarray, places: np.ndarray, s: Settings) -> tuple | None:
    """Shares in common and bounds of the best of an item's places in a text that passes both checks."""
    sought, answer = items.words[item], items.answers[item]
    order = np.lexsort((-places, -cosines))
    low, high = _region(places[order], len(words), len(sought), s)
    best, done = None, set()
    for a, z in zip(low.tolist(), high.tolist()):
        if (a, z) in done:
            continue
        done.add((a, z))
        region = words[a:z].tolist()
        common = common_words(sought, region) / len(sought)
        if common >= s.least_common and (best is None or common > best[0]):
            share = common_words(answer, region) / len(answer)
            if share >= s.least_answer:
                best = (common, share, a, z)
    return best


def _identity(text: str) -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, cosine, common, answer, first_word, last_word, h1, h2) of all matches."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", *_identity("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    tokens = materialize(rows.mapInArrow(_tokens, f"doc_id {id_type}, words array<int>, h1 long, h2 long"), "tokens")
    space = latent_space(tokens.select("doc_id", "words"), s)
    items = benchmark.select("item_id", "text").filter("text is not null").distinct()
    item_type = items.schema["item_id"].dataType.simpleString()
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-count // s.items), -(-size // s.item_bytes))
    kinds = [pa.int64() if t in ("bigint", "int") else pa.string() for t in (id_type, item_type)]
    shared = spark.sparkContext.broadcast(space)
    hits = None
    for part in range(parts):
        chosen = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        own = spark.sparkContext.broadcast(Items.some(sorted(map(tuple, chosen.collect()), key=str), space))
        found = tokens.mapInArrow(_search(shared, own, *kinds), f"doc_id {id_type}, item_id {item_type}, {HITS}")
        hits = found if hits is None else hits.unionByName(found)
    return hits.dropDuplicates(["doc_id", "h1", "h2", "item_id"])


def without_leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose own text holds no benchmark item, whatever other rows share their id."""
    own = [fresh(docs, name) for name in ("leak_id", "leak_h1", "leak_h2")]
    found = leaks(docs, benchmark, s).select("doc_id", "h1", "h2").distinct().toDF(*own)
    same = F.col("doc_id").eqNullSafe(F.col(own[0]))
    for column, name in zip(_identity("text"), own[1:]):
        same &= column == F.col(name)
    return docs.join(found, same, "left_anti")
