"""Run-length index of a block of byte strings, for matches of a fixed length.

The suffixes of the concatenated strings are sorted by their first ``LENGTH`` bytes, and
their Burrows-Wheeler transform is kept as runs. Each run carries its sampled ends: where
it begins and ends in the text, and the earliest text position in it. Runs are also cut
where a repeated context (``LENGTH`` bytes that occur more than once) begins or ends, so
the earliest occurrence of a context is a minimum over whole runs.

Strings are streamed from right to left. The matching statistic of a position is its match
length, counted up to ``LENGTH``, and the earliest position of that match.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LENGTH = 100
SEPARATOR = 0xFF  # a byte that UTF-8 never has


@dataclass
class RunIndex:
    keys: np.ndarray  # runs in order of their byte and place: byte << 32 | first row
    first: np.ndarray  # first row of these runs
    size: np.ndarray
    target: np.ndarray  # where the rows of these runs go when their byte is put in front
    byte_start: np.ndarray  # first row whose suffix begins with each byte
    head: np.ndarray  # text position of the first row of each run, in row order
    tail: np.ndarray
    context_first: np.ndarray  # rows of the repeated contexts
    context_last: np.ndarray
    earliest: np.ndarray  # text position of a context's first occurrence


def _codes(text: np.ndarray) -> tuple[np.ndarray, int]:
    """Bytes as small numbers in the same order, and the bits they take."""
    used = np.zeros(256, bool)
    used[text] = True
    return (np.cumsum(used) - 1)[text].astype(np.uint64), max(1, int(used.sum() - 1).bit_length())


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    ordered = key[order]
    new = np.zeros(len(key), np.uint64)
    np.cumsum(ordered[1:] != ordered[:-1], out=new[1:])
    rank = np.empty(len(key), np.uint64)
    rank[order] = new
    return rank, order


def _moved(values: np.ndarray, by: int) -> np.ndarray:
    """Values ``by`` places further on; beyond the end all are the largest."""
    out = np.full(len(values), values[-1])
    if by < len(values):
        out[: len(values) - by] = values[by:]
    return out


def _contexts(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every position by its next ``length`` bytes, and positions in that order."""
    codes, bits = _codes(text)
    key, known = codes, 1
    for _ in range(min(64 // bits, length) - 1):
        key = (key << np.uint64(bits)) | _moved(codes, known)
        known += 1
    rank, order = _ranked(key)
    width = max(1, int(rank.max()).bit_length())
    while known < length:
        parts = min(64 // width, -(-length // known))
        shifts = [min(known * k, length - known) for k in range(parts)]
        key = rank
        for shift in shifts[1:]:
            key = (key << np.uint64(width)) | _moved(rank, shift)
        known += shifts[-1]
        rank, order = _ranked(key)
        width = max(1, int(rank.max()).bit_length())
    return rank, order


def build(text: np.ndarray, length: int = LENGTH) -> RunIndex:
    """Index of a text that ends with at least one separator."""
    n = len(text)
    rank, order = _contexts(text, length)
    before = text[order - 1]
    ordered = rank[order]
    edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
    repeated = np.flatnonzero(np.diff(edge) > 1)
    context_first, context_last = edge[repeated], edge[repeated + 1]

    cut = np.r_[True, before[1:] != before[:-1]]
    cut[context_first] = True
    cut[context_last[context_last < n]] = True
    first = np.flatnonzero(cut)
    size = np.diff(np.r_[first, n])
    byte = before[first].astype(np.int64)
    least = np.minimum.reduceat(order, first)
    run = np.searchsorted(first, np.stack([context_first, context_last], axis=1).ravel())
    earliest = np.minimum.reduceat(np.r_[least, n], run)[::2] if len(run) else np.empty(0, np.int64)

    keys = byte << 32 | first
    place = np.argsort(before[first], kind="stable")
    target = np.cumsum(size[place]) - size[place]
    return RunIndex(
        keys=keys[place],
        first=first[place],
        size=size[place],
        target=target,
        byte_start=np.cumsum(np.bincount(text, minlength=256)) - np.bincount(text, minlength=256),
        head=order[first],
        tail=order[first + size - 1],
        context_first=context_first,
        context_last=context_last,
        earliest=earliest,
    )


def _step(index: RunIndex, byte: np.ndarray, row: np.ndarray) -> np.ndarray:
    """First row, of those that begin with ``byte``, whose rest is not before ``row``."""
    run = np.searchsorted(index.keys, byte << 32 | row) - 1
    inside = index.target[run] + np.minimum(row - index.first[run], index.size[run])
    return np.where((run >= 0) & (index.keys[run] >> 32 == byte), inside, index.byte_start[byte])


def earliest_matches(index: RunIndex, text: np.ndarray, start: np.ndarray, stop: np.ndarray, length: int = LENGTH):
    """For strings ``text[start:stop]``: (string, offset, earliest) of each match of full length.

    ``earliest`` is the first position in the indexed text with the same ``length`` bytes,
    for contexts that occur more than once there.
    """
    string = np.arange(len(start))
    place, left = stop.copy(), stop - start
    low = np.zeros(len(start), np.int64)
    high = np.full(len(start), int(index.size.sum()), np.int64)
    found = []
    for t in range(1, int(left.max(initial=0)) + 1):
        live = left >= t
        if not live.all():
            string, place, left, low, high = (x[live] for x in (string, place, left, low, high))
        place = place - 1
        # Streams stay in the order of their rows, so lookups run through the runs once.
        byte = text[place]
        turn = np.argsort(byte, kind="stable")
        string, place, left, low, high = (x[turn] for x in (string, place, left, low, high))
        byte = byte[turn].astype(np.int64)
        low, high = _step(index, byte, low), _step(index, byte, high)
        if t < length or not len(index.context_first):
            continue
        # Shorten the match to the wanted length: the whole context that the row is in.
        context = np.searchsorted(index.context_first, low, side="right") - 1
        hit = (context >= 0) & (low < index.context_last[context]) & (high > low)
        low = np.where(hit, index.context_first[context], low)
        high = np.where(hit, index.context_last[context], high)
        k = np.flatnonzero(hit)
        found.append((string[k], left[k] - t, index.earliest[context[k]]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*found))


def later_occurrences(strings: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string the offsets whose ``length`` bytes also begin earlier in the list."""
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    sizes = np.array([len(s) for s in strings], np.int64)
    start = np.cumsum(sizes + 1) - sizes - 1
    index = build(text, length)
    string, offset, earliest = earliest_matches(index, text, start, start + sizes, length)
    later = earliest < start[string] + offset
    string, offset = string[later], offset[later]
    order = np.lexsort((offset, string))
    return np.split(offset[order], np.searchsorted(string[order], np.arange(1, len(strings))))
