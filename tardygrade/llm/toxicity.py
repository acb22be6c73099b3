"""Toxicity scores from a small recurrent network.

Method. A word enters as the embedding of the word and the mean embedding of its
character trigrams, so that unseen words are judged by their spelling. A bidirectional
gated recurrent network reads windows of words, attention pools its states, and a linear
layer gives the logit of the window. The logit of a text is that of its worst window, so
training is multiple-instance learning: after a start on random windows, each epoch trains
on the window that the network now finds worst, among all windows of the text. The network is
written and trained in numpy on a bounded number of whole texts; the logit is calibrated on
all windows of texts that it was not trained on.

Scoring reads every window of the whole text: windows of ``width`` words overlap, and the
last one ends with the text. A null or empty text, or one without words, has no window and
gets the score of an empty window. Equal texts get equal scores.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .labelled import class_counts, labelled_sample


@dataclass(frozen=True)
class Settings:
    """``rows`` bounds the labelled texts of each class, which are used whole.

    Windows of ``width`` words begin every ``stride`` words.
    """

    width: int = 32
    stride: int = 24
    rows: tuple[int, int] = (2400, 1600)
    held_back: float = 0.25
    hidden: int = 12
    word_dim: int = 12
    char_dim: int = 12
    trigrams: int = 1 << 12
    vocabulary: int = 20_000
    min_count: int = 3
    attention: int = 12
    steps: int = 1000
    warm: float = 0.3
    batch: int = 128
    rate: float = 6e-3
    word_dropout: float = 0.35
    seed: int = 7


EDGE = ".,;:!?\"'()[]{}*%$&#|<>-–—_"


def words_of(text: str) -> list[bytes]:
    return text.encode().split()


def spelled(word: bytes) -> str:
    """A word without case and surrounding signs."""
    return word.decode(errors="replace").strip(EDGE).lower()


def trigram_ids(word: str, buckets: int) -> list[int]:
    padded = f"<{word}>"
    return [zlib.crc32(padded[k : k + 3].encode()) % buckets for k in range(max(1, len(padded) - 2))]


def window_starts(n: int, width: int, stride: int) -> np.ndarray:
    """Starts of the overlapping windows of n words; the last window ends with the text."""
    if n <= width:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - width, stride), n - width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# The network ------------------------------------------------------------------


@dataclass
class Network:
    settings: Settings
    vocabulary: dict[str, int]
    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    _rows: dict[bytes, int] = field(default_factory=dict, repr=False)
    _table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")} | {"_rows": {}, "_table": None}

    @staticmethod
    def start(s: Settings, vocabulary: dict[str, int]) -> Network:
        random = np.random.default_rng(s.seed)

        def draw(*shape: int, scale: float = 0.0) -> np.ndarray:
            scale = scale or (1 / shape[0]) ** 0.5
            return random.normal(0, scale, shape).astype(np.float32)

        size, h = s.word_dim + s.char_dim, s.hidden
        weights = {
            "words": draw(len(vocabulary) + 1, s.word_dim, scale=0.1),
            "chars": draw(s.trigrams, s.char_dim, scale=0.3),
            "A": draw(2 * h, s.attention),
            "a": np.zeros(s.attention, np.float32),
            "v": draw(s.attention),
            "w": draw(2 * h),
            "b": np.zeros(1, np.float32),
        }
        for side in "fb":
            weights |= {f"W{side}": draw(size, 3 * h), f"b{side}": np.zeros(3 * h, np.float32), f"U{side}": draw(h, 3 * h)}
        return Network(s, vocabulary, weights)

    # Inputs

    def char_means(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = [trigram_ids(w, self.settings.trigrams) for w in words]
        sizes = np.array([len(x) for x in ids])
        flat = np.array([i for x in ids for i in x], np.int64)
        sums = np.add.reduceat(self.weights["chars"][flat], np.cumsum([0, *sizes[:-1]]), axis=0)
        return sums / sizes[:, None], flat, sizes

    def projected(self, words: list[str]) -> np.ndarray:
        """Input of both directions for each word; what the recurrence adds is left out."""
        own = self.weights["words"][[self.vocabulary.get(w, 0) for w in words]]
        x = np.concatenate([own, self.char_means(words)[0]], axis=1)
        return np.concatenate([x @ self.weights[f"W{side}"] + self.weights[f"b{side}"] for side in "fb"], axis=1)

    # Scoring

    def _rows_of(self, words: list[bytes], memory: int = 1 << 19) -> list[int]:
        """Rows of the words in the table of projected inputs, which is remembered."""
        known = self._rows
        found = [known.get(w) for w in words]
        if None not in found:
            return found
        if self._table is None or len(known) + len(words) > len(self._table):
            known.clear()
            wide = max(memory, len(words))
            if self._table is None or len(self._table) < wide:
                self._table = np.zeros((wide, 6 * self.settings.hidden), np.float32)
            found = [None] * len(words)
        new = list(dict.fromkeys(w for w, row in zip(words, found) if row is None))
        first = len(known)
        self._table[first : first + len(new)] = self.projected([spelled(w) for w in new])
        known.update(zip(new, range(first, first + len(new))))
        return [known[w] for w in words]

    def forget(self) -> None:
        """Gives up the remembered words."""
        self._rows, self._table = {}, None

    def logits(self, lines: list[str]) -> np.ndarray:
        """Logit of the worst window of each text."""
        s = self.settings
        split = [words_of(line) for line in lines]
        sizes = np.array([len(x) for x in split], np.int64)
        rows = np.array(self._rows_of([w for x in split for w in x]) + [0] * s.width, np.int64)
        starts = np.cumsum(sizes) - sizes
        worst = np.full(len(lines), float(self.weights["b"][0]), np.float64)
        worst[sizes > 0] = -np.inf
        windows = [window_starts(n, s.width, s.stride) for n in sizes]
        owner = np.repeat(np.arange(len(lines)), [len(x) for x in windows])
        if not len(owner):
            return worst
        at = np.concatenate(windows) + starts[owner]
        length = np.minimum(sizes[owner], s.width)
        for full in (True, False):
            chosen = np.flatnonzero((length == s.width) == full)
            for k in range(0, len(chosen), 2048):
                part = chosen[k : k + 2048]
                index = rows[at[part][:, None] + np.arange(s.width)]
                mask = None if full else (np.arange(s.width) < length[part][:, None]).astype(np.float32)
                np.maximum.at(worst, owner[part], self._window_logits(self._table[index], mask))
        return worst

    def _window_logits(self, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        return self._forward(x, mask)[0]

    def _forward(self, x: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows from their projected inputs (windows, words, both directions)."""
        p, h = self.weights, self.settings.hidden
        n, width = x.shape[:2]
        states = np.empty((n, width, 2 * h), np.float32)
        trace: dict[str, list] = {"f": [], "b": []}
        for d, side in enumerate("fb"):
            U = p[f"U{side}"]
            state = np.zeros((n, h), np.float32)
            for t in range(width) if side == "f" else range(width - 1, -1, -1):
                own = x[:, t, 3 * h * d : 3 * h * (d + 1)]
                back = state @ U
                gates = _sigmoid(own[:, : 2 * h] + back[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(own[:, 2 * h :] + r * back[:, 2 * h :])
                if keep:
                    trace[side].append((t, state, z, r, new, back[:, 2 * h :]))
                following = new + z * (state - new)
                if mask is not None:
                    m = mask[:, t, None]
                    following = m * following + (1 - m) * state
                state = following
                states[:, t, h * d : h * (d + 1)] = state
        hidden = np.tanh(states @ p["A"] + p["a"])
        energy = hidden @ p["v"]
        if mask is not None:
            energy = np.where(mask > 0, energy, -1e9)
        weight = np.exp(energy - energy.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", weight, states)
        return pooled @ p["w"] + p["b"][0], (states, hidden, weight, pooled, trace)

    # Training

    def gradients(self, ids: np.ndarray, mask: np.ndarray, label: np.ndarray, lexicon: Lexicon, random):
        """Loss gradients of a batch of windows of lexicon entries."""
        p, s = self.weights, self.settings
        h, n = s.hidden, len(ids)
        unique, place = np.unique(ids, return_inverse=True)
        place = place.reshape(ids.shape)
        flat, sizes = lexicon.trigrams(unique)
        means = np.add.reduceat(p["chars"][flat], np.cumsum([0, *sizes[:-1]]), axis=0) / sizes[:, None]
        numbers = lexicon.numbers[ids] * (random.random(ids.shape) >= s.word_dropout)
        inputs = np.concatenate([p["words"][numbers], means[place]], axis=2).astype(np.float32)
        x = np.concatenate([inputs @ p["Wf"] + p["bf"], inputs @ p["Wb"] + p["bb"]], axis=2)
        logit, (states, hidden, weight, pooled, trace) = self._forward(x, mask, keep=True)

        g = {k: np.zeros_like(v) for k, v in p.items()}
        error = ((_sigmoid(logit) - label) / n).astype(np.float32)
        g["w"], g["b"][0] = pooled.T @ error, error.sum()
        d_pooled = error[:, None] * p["w"]
        d_weight = np.einsum("nth,nh->nt", states, d_pooled)
        d_states = weight[:, :, None] * d_pooled[:, None, :]
        d_energy = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        g["v"] = np.einsum("nt,nta->a", d_energy, hidden)
        d_hidden = d_energy[:, :, None] * p["v"] * (1 - hidden**2)
        g["A"] = np.einsum("nth,nta->ha", states, d_hidden)
        g["a"] = d_hidden.sum((0, 1))
        d_states += d_hidden @ p["A"].T

        d_inputs = np.zeros_like(inputs)
        for d, side in enumerate("fb"):
            U, carry = p[f"U{side}"], np.zeros((n, h), np.float32)
            d_x = np.zeros((n, ids.shape[1], 3 * h), np.float32)
            for t, state, z, r, new, back in reversed(trace[side]):
                total = carry + d_states[:, t, h * d : h * (d + 1)]
                m = mask[:, t, None]
                d_next, carry = total * m, total * (1 - m)
                carry += d_next * z
                d_new = d_next * (1 - z) * (1 - new**2)
                d_z = d_next * (state - new) * z * (1 - z)
                d_r = d_new * back * r * (1 - r)
                d_back = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g[f"U{side}"] += state.T @ d_back
                carry += d_back @ U.T
                d_x[:, t] = np.concatenate([d_z, d_r, d_new], axis=1)
            g[f"W{side}"] = np.einsum("nti,ntj->ij", inputs, d_x)
            g[f"b{side}"] = d_x.sum((0, 1))
            d_inputs += d_x @ p[f"W{side}"].T
        np.add.at(g["words"], numbers, d_inputs[:, :, : s.word_dim])
        d_means = np.zeros((len(unique), s.char_dim), np.float32)
        np.add.at(d_means, place, d_inputs[:, :, s.word_dim :])
        np.add.at(g["chars"], flat, np.repeat(d_means / sizes[:, None], sizes, axis=0))
        return g

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * logits + self.shift)


class Lexicon:
    """The distinct words of the training windows with their inputs."""

    def __init__(self, words: list[str], vocabulary: dict[str, int], buckets: int):
        ids = [trigram_ids(w, buckets) for w in words]
        self.sizes = np.array([len(x) for x in ids], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.array([i for x in ids for i in x], np.int64)
        self.numbers = np.array([vocabulary.get(w, 0) for w in words], np.int64)

    def trigrams(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[entries]
        offsets = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.flat[np.repeat(self.starts[entries], sizes) + offsets], sizes


@dataclass
class _Bags:
    """All windows of some texts, as places in one list of words; texts hold lexicon entries."""

    entries: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    length: np.ndarray
    width: int

    @staticmethod
    def of(texts: list[np.ndarray], s: Settings) -> _Bags:
        sizes = np.array([len(x) for x in texts], np.int64)
        windows = [window_starts(n, s.width, s.stride) for n in sizes]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in windows])
        start = np.concatenate([*windows, np.empty(0, np.int64)]) + (np.cumsum(sizes) - sizes)[owner]
        entries = np.concatenate([*texts, np.zeros(s.width, np.int32)])
        return _Bags(entries, owner, start, np.minimum(sizes[owner], s.width), s.width)

    def inputs(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of some windows, and which of them are words."""
        mask = np.arange(self.width) < self.length[some][:, None]
        return np.where(mask, self.entries[self.start[some][:, None] + np.arange(self.width)], 0), mask.astype(np.float32)


def _numbered(texts: list[str]) -> tuple[list[np.ndarray], list[str], Counter]:
    """Entries of the words of each text, the sorted entries, and in how many texts each word is."""
    number: dict[bytes, int] = {}
    raw = [np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int32) for text in texts]
    spelling = [spelled(w) for w in number]
    words = sorted(set(spelling))
    place = {w: k for k, w in enumerate(words)}
    entry = np.array([place[w] for w in spelling], np.int32)
    seen: Counter = Counter()
    numbered = [entry[own] if len(own) else own for own in raw]
    for own in numbered:
        seen.update(np.unique(own).tolist())
    return numbered, words, Counter({words[k]: c for k, c in seen.items()})


def train(texts: list[str], labels: list[int], base_rate: float, s: Settings = Settings()) -> Network:
    """Fit on whole texts; ``base_rate`` is the share of class 1 among all."""
    label = np.array(labels, np.float32)
    numbered, words, seen = _numbered(texts)
    common = [w for w, c in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if c >= s.min_count][: s.vocabulary]
    net = Network.start(s, {w: k + 1 for k, w in enumerate(common)})
    bags = _Bags.of(numbered, s)
    if len(set(labels)) < 2:
        net.shift, net.slope = (20.0 if labels and labels[0] else -20.0), 0.0
        return net
    if len(np.unique(label[bags.owner])) < 2:  # one class has no words
        net.shift, net.slope = float(np.log(base_rate / (1 - base_rate))), 0.0
        return net

    lexicon, owner = Lexicon(words, net.vocabulary, s.trigrams), bags.owner
    random = np.random.default_rng(s.seed)
    back = random.random(len(texts)) < s.held_back
    for value in (0, 1):  # both parts need both classes
        own = np.flatnonzero(label == value)
        if len(own) > 1:
            back[own[0]], back[own[1]] = False, True
    trainable = np.flatnonzero(~back[owner])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.weights.items()}
    steps = 0
    while steps < s.steps:
        noise = random.random(len(owner))
        if steps < s.warm * s.steps:
            chosen = _best_of(trainable, owner, noise, 4)
        else:
            logits = np.empty(len(owner))
            logits[trainable] = _lexicon_logits(net, bags, trainable, lexicon)
            hard = _best_of(trainable, owner, logits, 1)
            calm = trainable[label[owner[trainable]] == 0]
            chosen = np.concatenate([hard, _best_of(calm, owner, noise, 2)])
        # As many windows of one class as of the other.
        sides = [chosen[label[owner[chosen]] == value] for value in (0, 1)]
        most = max(map(len, sides))
        chosen = np.concatenate([np.resize(random.permutation(side), most) for side in sides])
        chosen = random.permutation(chosen)
        rate = s.rate * (1.0 if steps < 0.6 * s.steps else 0.3)
        for k in range(0, len(chosen), s.batch):
            part = chosen[k : k + s.batch]
            g = net.gradients(*bags.inputs(part), label[owner[part]], lexicon, random)
            steps += 1
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            for name, grad in g.items():
                grad = grad * min(1.0, 1.0 / (norm + 1e-9))
                first, second = moments[name]
                first += 0.1 * (grad - first)
                second += 0.001 * (grad**2 - second)
                net.weights[name] -= rate * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-8)

    worst = np.full(len(texts), float(net.weights["b"][0]))
    worst[np.unique(owner)] = -np.inf
    unseen = np.flatnonzero(back[owner])
    np.maximum.at(worst, owner[unseen], _lexicon_logits(net, bags, unseen, lexicon))
    share = label[back].mean()
    weight = np.where(label[back] > 0, base_rate / share, (1 - base_rate) / (1 - share))
    net.slope, net.shift = calibrate(worst[back], label[back], weight)
    return net


def _best_of(rows: np.ndarray, owner: np.ndarray, value: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` rows of each owner with the largest value."""
    order = rows[np.lexsort((-value[rows], owner[rows]))]
    own = owner[order]
    rank = np.arange(len(order)) - np.searchsorted(own, own)
    return order[rank < count]


def _lexicon_logits(net: Network, bags: _Bags, some: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Logits of some windows."""
    p, everything = net.weights, np.arange(len(lexicon.numbers))
    flat, sizes = lexicon.trigrams(everything)
    means = np.add.reduceat(p["chars"][flat], np.cumsum([0, *sizes[:-1]]), axis=0) / sizes[:, None]
    inputs = np.concatenate([p["words"][lexicon.numbers], means], axis=1).astype(np.float32)
    table = np.concatenate([inputs @ p["Wf"] + p["bf"], inputs @ p["Wb"] + p["bb"]], axis=1)
    found = np.empty(len(some))
    for k in range(0, len(some), 2048):
        ids, mask = bags.inputs(some[k : k + 2048])
        found[k : k + 2048] = net._window_logits(table[ids], None if mask.all() else mask)
    return found


def calibrate(x: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """Slope (not negative) and shift of a weighted logistic regression on one input."""
    mean, scale = float(np.average(x, weights=weight)), float(x.std()) + 1e-9
    u, beta = (x - mean) / scale, np.zeros(2)
    design = np.stack([u, np.ones_like(u)], axis=1)
    for _ in range(50):
        p = _sigmoid(design @ beta)
        gradient = design.T @ (weight * (p - label)) / weight.sum() + ridge * beta * [1, 0]
        curvature = (design * (weight * p * (1 - p) / weight.sum())[:, None]).T @ design + np.diag([ridge, 1e-6])
        step = np.linalg.solve(curvature, gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(float(beta[0]), 0.0) / scale
    return slope, float(beta[1]) - slope * mean


# On Spark ---------------------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", s: Settings = Settings()) -> Network:
    """Train on a bounded sample of the labelled documents that ``allowed`` admits.

    The sample has at most ``rows`` whole texts of each class, so the number of texts that
    reach the driver does not grow with the input.
    """
    sample = labelled_sample(docs, labels, label, allowed, dict(enumerate(s.rows)), s.seed)
    rows = sorted(sample.select("doc_id", F.col("label").cast("int"), "text").collect(), key=lambda r: (r[0], r[2]))
    counts = class_counts(labels.filter(allowed), label)
    rate = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    return train([r[2] for r in rows], [r[1] for r in rows], rate, s)


def scored(df: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the calibrated probability of class 1 to every row."""
    model = df.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model.value
        for column in columns:
            lines = texts(column)
            parts = [own.logits(lines[k : k + 64]) for k in range(0, len(lines), 64)]
            yield pa.array(own.probability(np.concatenate([*parts, []])), pa.float64())
        # The worker may go on with another operator.
        own.forget()

    return df.withColumn(out, score(text))
