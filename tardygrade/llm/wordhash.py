"""64-bit hashes of the words of texts, all words of a part at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

# Texts are hashed in parts of about so many bytes, which bounds the arrays in use.
WINDOW = 1 << 19
_SHORT = 64  # words of more bytes are hashed one by one
_RANDOM = np.random.default_rng(4711).integers(0, 1 << 64, (2, 256), np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(raw: bytes, size: int = WINDOW) -> Iterator[tuple[int, bytes]]:
    """(place, part) of parts of about ``size`` bytes; cuts are at blanks and line ends, so words stay whole."""
    start = 0
    while start < len(raw):
        end = start + size
        if end < len(raw):
            cut = max(raw.rfind(b" ", start + 1, end), raw.rfind(b"\n", start + 1, end))
            if cut < 0:
                later = [k for k in (raw.find(b" ", end), raw.find(b"\n", end)) if k >= 0]
                cut = min(later, default=len(raw))
            end = cut
        yield start, raw[start:end]
        start = end


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of ``raw`` and their first and last places; blanks and line ends separate words.

    A word's hash is a sum over its bytes, each weighted by its place in the word.
    """
    values = np.frombuffer(raw, np.uint8)
    inside = (values != 10) & (values != 32)
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    start, stop = edges[::2], edges[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start, stop
    at = np.flatnonzero(inside)
    size = stop - start
    first = np.cumsum(size) - size
    place = (np.arange(len(at)) - np.repeat(first, size)) & 255
    sums = np.add.reduceat(_RANDOM[0, values[at]] * _RANDOM[1, place], first)
    for k in np.flatnonzero(size > _SHORT):
        sums[k] = xxhash.xxh64_intdigest(raw[start[k] : stop[k]])
    return mixed(sums), start, stop
