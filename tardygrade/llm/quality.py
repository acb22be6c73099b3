"""Quality scores by compression.

Method. Labelled texts are cut into pieces of about a kilobyte; one zstandard dictionary is
built from pieces of good texts and one from pieces of bad ones. A text is cut in the same
way, every piece is compressed with either dictionary, and the difference of the total sizes
over their sum is the raw score: text like the good sample is smaller with its dictionary. A
logistic curve, fitted on labelled texts that no dictionary has seen and weighted to the
share of good texts among all, turns it into a probability.

The whole text counts. A null or empty text has no pieces and a difference of 0. Equal texts
get equal scores. If only one class is labelled, all texts get its probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .labelled import class_counts, labelled_sample


@dataclass(frozen=True)
class Settings:
    """``rows`` bounds the labelled texts of each class, which are used whole."""

    piece: int = 1024
    rows: tuple[int, int] = (2000, 2000)
    dictionary: int = 64 << 10
    level: int = 3
    held_back: float = 0.4
    seed: int = 5


def cut(text: str, size: int) -> list[bytes]:
    raw = text.encode()
    return [raw[k : k + size] for k in range(0, len(raw), size)]


def build_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Compressors:
    good: bytes
    bad: bytes
    settings: Settings
    slope: float = 0.0
    shift: float = 0.0
    _ready: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_ready": []}

    def difference(self, text: str) -> float:
        """Relative gain of the good dictionary over the bad one."""
        if not self._ready:
            for raw in (self.good, self.bad):
                own = zstandard.ZstdCompressionDict(raw)
                own.precompute_compress(level=self.settings.level)
                self._ready.append(zstandard.ZstdCompressor(level=self.settings.level, dict_data=own).compress)
        parts = cut(text, self.settings.piece)
        good, bad = (sum(len(compress(p)) for p in parts) for compress in self._ready)
        return (bad - good) / (bad + good) if parts else 0.0

    def scores(self, lines: list[str]) -> np.ndarray:
        x = np.array([self.difference(line) for line in lines] if self.slope else [0.0] * len(lines))
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -30, 30)))


def _logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one input, slightly held towards 0."""
    scale = float(x.std()) + 1e-9
    design, beta = np.stack([x / scale, np.ones_like(x)], axis=1), np.zeros(2)
    weight, ridge = weight / weight.sum(), np.array([1e-3, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - label)) + ridge * beta
        curvature = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.clip(np.linalg.solve(curvature, gradient), -3, 3)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.0) / scale, float(beta[1])


def train(lines: list[str], labels: list[int], good_rate: float, s: Settings = Settings()) -> Compressors:
    """Dictionaries from all pieces of a part of the texts, calibration on the other texts, whole."""
    label = np.array(labels)
    if len(set(labels)) < 2:
        rate = good_rate if len(labels) else 0.5
        return Compressors(b"", b"", s, 0.0, float(np.log(rate / (1 - rate))))
    random = np.random.default_rng(s.seed)
    back = random.random(len(labels)) < s.held_back
    for value in (0, 1):
        own = np.flatnonzero(label == value)
        if len(own) > 1:
            back[own[0]], back[own[1]] = False, True
    raw = [[p for k in np.flatnonzero(~back & (label == v)) for p in cut(lines[k], s.piece)] for v in (1, 0)]
    model = Compressors(*[build_dictionary(part, s.dictionary) for part in raw], s, slope=1.0)
    if not back.any() or len(set(label[back])) < 2:
        back = np.ones(len(label), bool)
    x = np.array([model.difference(lines[k]) for k in np.flatnonzero(back)])
    y = label[back].astype(float)
    weight = np.where(y > 0, good_rate / y.mean(), (1 - good_rate) / (1 - y.mean()))
    model.slope, model.shift = _logistic(x, y, weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", s: Settings = Settings()) -> Compressors:
    """Train on a bounded sample of the labelled documents that ``allowed`` admits."""
    sample = labelled_sample(docs, labels, label, allowed, dict(enumerate(s.rows)), s.seed)
    rows = sorted(sample.select("doc_id", F.col("label").cast("int"), "text").collect(), key=lambda r: (r[0], r[2]))
    counts = class_counts(labels.filter(allowed), label)
    rate = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    return train([r[2] for r in rows], [r[1] for r in rows], rate, s)


def scored(df: DataFrame, model: Compressors, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the calibrated probability of good quality to every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts(column)), pa.float64())

    return df.withColumn(out, score(text))
