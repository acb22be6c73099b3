import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tardygrade.llm import quality, toxicity
from tardygrade.llm.common import crc_fold, fold_of
from tardygrade.llm.labelled import labelled_sample

SMALL = toxicity.Settings(rows=(200, 120), steps=150, hidden=6, word_dim=6, char_dim=6, attention=6)
BAD = ["idiot", "moron", "loser", "scum"]


def auc(label, score):
    label, score = np.array(label), np.array(score)
    wins = (score[label == 1][:, None] > score[label == 0]) + 0.5 * (score[label == 1][:, None] == score[label == 0])
    return wins.mean()


def prose(choose, n):
    return " ".join(choose.choice(["the", "of", "and", "river", "stone", "house", "tree", "runs", "sleeps"]) + choose.choice(["", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    choose, rows, labels = random.Random(3), [], []
    for k in range(420):
        words = prose(choose, choose.randint(5, 120)).split()
        toxic, good = int(k % 3 == 0), int(k % 4 != 0)
        if toxic:
            for _ in range(2):
                words.insert(choose.randint(0, len(words)), choose.choice(BAD))
        if not good:
            words = [w + choose.choice(["%%%", "###", "$$$", "&&&"]) for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, good, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_texts(spark, tables):
    docs, labels = tables
    fold = crc_fold("doc_id", 5)
    net = toxicity.fit(docs, labels, fold != 0, s=SMALL)
    again = toxicity.fit(docs.repartition(7), labels.repartition(3), fold != 0, s=SMALL)
    assert all((net.weights[k] == again.weights[k]).all() for k in net.weights)
    found = toxicity.scored(docs, net).join(labels, "doc_id").filter(fold == 0).collect()
    assert len(found) > 50 and auc([r["toxic"] for r in found], [r["score"] for r in found]) > 0.9


def test_toxicity_gradients():
    net = toxicity.Network.start(SMALL, {"a": 1, "b": 2})
    words = ["a", "b", "cc", "dd"]
    lexicon = toxicity.Lexicon(words, net.vocabulary, SMALL.trigrams)
    ids = np.array([[0, 1, 2, 3], [2, 2, 1, 0]])
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], np.float32)
    label = np.array([1.0, 0.0], np.float32)
    for k in net.weights:
        net.weights[k] = net.weights[k].astype(np.float64)

    class Never:
        def random(self, shape):
            return np.ones(shape)

    def loss():
        table = net.projected(words)
        logit = net._window_logits(table[ids], mask)
        p = 1 / (1 + np.exp(-logit))
        return float(-(label * np.log(p) + (1 - label) * np.log(1 - p)).mean())

    g = net.gradients(ids, mask, label, lexicon, Never())
    for name, place in (("Uf", (1, 2)), ("Wb", (0, 1)), ("A", (1, 1)), ("v", (2,)), ("w", (0,)), ("words", (1, 0)), ("bf", (3,))):
        old = net.weights[name][place]
        net.weights[name][place] = old + 1e-3
        up = loss()
        net.weights[name][place] = old - 1e-3
        down = loss()
        net.weights[name][place] = old
        assert g[name][place] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-5), name


def test_every_window_counts(tables):
    for n in (0, 1, 31, 32, 33, 100, 1000):
        starts = toxicity.window_starts(n, 32, 24)
        covered = {k for s in starts for k in range(s, min(n, s + 32))}
        assert covered == set(range(n))


def test_scores_of_odd_rows(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "  \n ", "x"), (3, "word " * 40_000, "x"), (4, "fine idiot", "x")],
        "doc_id long, text string, score string",
    )
    net = toxicity.fit(docs, labels, F.lit(True), s=SMALL)
    model = quality.fit(docs, labels, F.lit(True))
    for found in (toxicity.scored(odd, net), quality.scored(odd, model)):
        scores = [r["score"] for r in found.collect()]
        assert len(scores) == 6 and all(0 <= x <= 1 for x in scores)
        assert scores[0] == scores[1] == scores[2]
    assert toxicity.scored(odd.limit(0), net).count() == 0 and quality.scored(odd.limit(0), model).count() == 0
    nothing = labels.limit(0)
    assert 0 <= toxicity.scored(odd, toxicity.fit(docs, nothing, F.lit(True), s=SMALL)).first()["score"] <= 1
    assert 0 <= quality.scored(odd, quality.fit(docs, nothing, F.lit(True))).first()["score"] <= 1
    only_good = labels.filter("quality = 1")
    assert quality.scored(odd, quality.fit(docs, only_good, F.lit(True))).first()["score"] > 0.9


def test_quality_on_held_out_texts(spark, tables):
    docs, labels = tables
    fold = crc_fold("doc_id", 4)
    model = quality.fit(docs, labels, fold != 2)
    found = quality.scored(docs, model).join(labels, "doc_id").filter(fold == 2).collect()
    assert len(found) > 60 and auc([r["quality"] for r in found], [r["score"] for r in found]) > 0.95


def test_folds(spark):
    df = spark.createDataFrame([(k,) for k in (0, 7, 123456, -5)], "doc_id long").withColumn("f", crc_fold("doc_id", 5))
    assert all(r["f"] == fold_of(r["doc_id"], 5) for r in df.collect())


def test_a_repeated_id_counts_once(spark):
    rows = [(1, f"text {k % 7}") for k in range(500)] + [(2, "b"), (2, None), (3, "c"), (None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    chosen = labelled_sample(docs, labels, "toxic", F.lit(True), {0: 5, 1: 5})
    found = sorted((r["doc_id"], r["label"], r["text"]) for r in chosen.select("doc_id", "label", "text").collect())
    assert [r[:2] for r in found] == [(1, 1), (2, 0)]
    again = labelled_sample(docs.repartition(3, "text"), labels, "toxic", F.lit(True), {0: 5, 1: 5})
    assert found == sorted((r["doc_id"], r["label"], r["text"]) for r in again.select("doc_id", "label", "text").collect())
