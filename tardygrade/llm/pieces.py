"""Encoding and decoding with a SentencePiece model of the merge (BPE) type.

Method. Every prefix of a text has a unique encoding, and the encoding of a prefix is
that of a shorter prefix plus one last token. So it is enough to store one token for each
prefix. An Aho-Corasick automaton over the vocabulary lists the tokens that end at a
position; the one sought is the token whose left neighbour, the last token of the prefix
before it, is *compatible* with it: merging the characters of both gives just these two
tokens again. Afterwards the ids are read off the table backwards.

Results. Ids equal those of the library without sampling; decoding equals its
``decode``. A null text is an empty one, and an empty text has only the begin and end
ids. Texts are processed whole; equal texts in repeated rows get equal rows. Other
columns pass through, and an existing column with the name of the result is replaced.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import int_lists, texts

SPACE = "▁"
REPLACEMENT = "�".encode()
NEVER = float("-inf")


# Encoded words that a worker remembers by default.
MEMORY = 3 << 19


class PieceTable:
    """Vocabulary of one model with the prefix-table encoder.

    ``memory`` bounds the encoded words that a worker remembers. They are kept in two halves, of
    which the older one is dropped when the newer one is full, so that words that come often stay.
    200 bytes a word are needed, and as much again in all for tested pairs.
    """

    def __init__(self, model_path: str, memory: int = MEMORY):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(model.get_piece_size())
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i)}
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.ids = {model.id_to_piece(i): i for i in ids if i not in special and not model.is_byte(i)}
        self.scores = {piece: model.get_score(i) for piece, i in self.ids.items()}
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.memory = memory

        # Letters of the vocabulary can be tokens until they merge; others never merge.
        self.letters = frozenset("".join(self.ids))
        self._token = ["", *sorted(self.letters.union(self.ids))]
        self._number = {token: k for k, token in enumerate(self._token)}
        self._packed_ids = [np.array(self._ids_of(token), "<i4").tobytes() for token in self._token]
        self._size = [len(token) for token in self._token]
        self.automaton = ahocorasick.Automaton()
        for token, k in self._number.items():
            if token:
                self.automaton.add_word(token, (k, len(token), k << 24))
        self.automaton.make_automaton()
        # Pairs, left << 24 | right, that were found to be compatible, and those that were not.
        self._good: set[int] = set()
        self._bad: set[int] = set()
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

        # A text can be cut where no token reaches across: before a space after
        # something else, and around line ends, if the vocabulary has no such token.
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.ids):
            pattern = r"[\s\S]+"
        elif any("\n" in piece for piece in self.ids):
            pattern = f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        else:
            pattern = f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+"
        self._cut = re.compile(pattern).findall

        self.surface = [model.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        self.leading = [model.id_to_piece(i).startswith(SPACE) for i in ids]
        for i in special:
            self.surface[i] = b"" if model.is_control(i) else " ⁇ ".encode()
        for byte, i in self.byte_ids.items():
            self.surface[i] = bytes([byte])
        self.is_byte = frozenset(self.byte_ids.values())
        self.is_control = frozenset(i for i in special if model.is_control(i))

    # Encoding -----------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Merge the characters of a short text, best score first and leftmost among equals."""
        parts, get = list(text), self.scores.get
        scores = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], NEVER)
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], NEVER)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``left`` followed by ``right`` stays these two tokens; ``left`` may be empty."""
        return self.merge(left + right) == ([left, right] if left else [right])

    def _fits(self, pair: int) -> bool:
        """``compatible`` by numbers, remembered."""
        if len(self._good) + len(self._bad) >= 2 * self.memory:
            self._good.clear()
            self._bad.clear()
        fits = self.compatible(self._token[max(pair >> 24, 0)], self._token[pair & 0xFFFFFF])
        (self._good if fits else self._bad).add(pair)
        return fits

    def _table(self, word: str) -> list[int]:
        """The last token of each prefix by number << 24; negative for a letter that is in no token."""
        last = [0] * (len(word) + 1)
        if not self.letters.issuperset(word):
            for k, letter in enumerate(word):
                if letter not in self.letters:
                    last[k + 1] = -1 << 24
        good, bad = self._good, self._bad
        for end, (token, size, shifted) in self.automaton.iter(word):
            end += 1
            if not last[end]:
                pair = last[end - size] | token
                if pair in good or (pair not in bad and self._fits(pair)):
                    last[end] = shifted
        return last

    def tokens(self, word: str) -> list[str]:
        """Tokens of a text; spaces are already escaped."""
        last, found, at = self._table(word), [], len(word)
        while at:
            found.append(self._token[last[at] >> 24] if last[at] > 0 else word[at - 1])
            at -= len(found[-1])
        return found[::-1]

    def _ids_of(self, token: str) -> list[int]:
        return [self.ids[token]] if token in self.ids else [self.byte_ids[b] for b in token.encode()]

    def _encode_word(self, word: str) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            last, packed, at = self._table(word), [], len(word)
            while at:
                token = last[at] >> 24
                if token > 0:
                    packed.append(self._packed_ids[token])
                    at -= self._size[token]
                else:
                    packed.append(np.array(self._ids_of(word[at - 1]), "<i4").tobytes())
                    at -= 1
            packed.reverse()
            ids = b"".join(packed)
        if len(word) <= 64:
            if 2 * len(self._words) >= self.memory:
                self._older, self._words = self._words, {}
            self._words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers, without begin and end ids."""
        if not text:
            return b""
        words = self._cut(SPACE + text.replace(" ", SPACE))
        # The halves change places in between, so the present one is asked for each time.
        return b"".join([self._words.get(word) or self._encode_word(word) for word in words])

    # Decoding -----------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids: bytes that form no character become replacement characters."""
        first = next((i for i in ids if i not in self.is_control), None)
        raw = b"".join(map(self.surface.__getitem__, ids))
        skip = first is not None and self.leading[first]
        try:
            return raw[skip:].decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids)[skip:].decode()

    def _decode_runs(self, ids: list[int]) -> bytes:
        out, run = [], b""
        for i in [*ids, None]:
            if i in self.is_byte:
                run += self.surface[i]
                continue
            while run:
                width = next((w for w in range(1, 5) if _is_character(run[:w])), 0)
                out.append(run[:width] if width else REPLACEMENT)
                run = run[max(width, 1) :]
            if i is not None:
                out.append(self.surface[i])
        return b"".join(out)


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def piece_table(model_path: str, memory: int = MEMORY) -> PieceTable:
    """The table of a model, built once in each Python worker."""
    return PieceTable(model_path, memory)


# Columns ----------------------------------------------------------------------


def encoded(text: str | Column, model_path: str, bos: bool = True, eos: bool = True, memory: int = MEMORY) -> Column:
    """Token ids of a text column as ``array<int>``."""

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        table = piece_table(model_path, memory)
        before = np.array([table.bos] * bos, "<i4").tobytes()
        after = np.array([table.eos] * eos, "<i4").tobytes()
        packed = [before + table.encode(text) + after for text in texts(column)]
        return int_lists(np.frombuffer(b"".join(packed), "<i4"), [len(p) // 4 for p in packed])

    return encode(text)


def decoded(ids: str | Column, model_path: str, memory: int = MEMORY) -> Column:
    """Texts of a column of token ids; null lists give the empty text."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        table = piece_table(model_path, memory)
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), _bounds(column)
        return pa.array([table.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())

    return decode(ids)


def ids_digest(ids: str | Column) -> Column:
    """SHA-256 of ids as little-endian unsigned 32-bit integers, in lowercase hex."""

    @F.arrow_udf("string")
    def digest(column: pa.Array) -> pa.Array:
        flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype("<u4"), _bounds(column)
        return pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(ends, ends[1:])], pa.string())

    return digest(ids)


def _bounds(column: pa.ListArray) -> list[int]:
    """Where each list begins in the flattened values, and where the last ends."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return [0, *np.cumsum(sizes).tolist()]


def round_trip(df: DataFrame, model_path: str, text: str = "text", memory: int = MEMORY) -> DataFrame:
    """Adds ``ids`` (with begin and end ids) and ``decoded`` to every row."""
    coded = df.withColumn("ids", encoded(text, model_path, memory=memory))
    return coded.withColumn("decoded", decoded("ids", model_path, memory))
