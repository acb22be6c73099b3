import random

import numpy as np
import pytest
from scipy_free import posterior

from tardygrade.llm import jaccard
from tardygrade.llm.graph import components


def brute(rows, s):
    """(doc_id, class_id, text_id, n_links, n_copies) by comparing all texts."""
    def shingles(text):
        w = (text or "").encode().split()
        return {tuple(w[k : k + s.words]) for k in range(len(w) - s.words + 1)} or ({tuple(w)} if w else set())

    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    sets = {t: shingles(t) for t in texts}
    links = {t: [u for u in texts if u != t and sets[t] & sets[u] and len(sets[t] & sets[u]) / len(sets[t] | sets[u]) >= s.threshold] for t in texts}
    first = {t: min((i for i in ids if i is not None), default=None) for t, ids in texts.items()}
    out = []
    for i, t in rows:
        seen, todo = {t or ""}, [t or ""]
        while todo:
            for u in links[todo.pop()]:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        known = [first[u] for u in seen if first[u] is not None]
        out.append((i, min(known, default=None), first[t or ""], len(links[t or ""]), len(texts[t or ""])))
    return sorted(out, key=str)


def corpus():
    choose = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for family in range(6):
        base = choose.choices(words, k=choose.randint(30, 90))
        for _ in range(9):
            own = list(base)
            for _ in range(choose.randint(0, 3)):
                own[choose.randrange(len(own))] = choose.choice(words)
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, "  \n", "one two", "one\ttwo", "one two three", rows[3][1], "long " * 30_000])]
    rows += [(5, rows[5][1]), (None, rows[8][1]), (None, "nobody knows the id of this one text")]
    return rows


def test_join_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    for s in (jaccard.Settings(), jaccard.Settings(block=4)):
        found = sorted((tuple(r) for r in jaccard.similar_texts(df, s=s).collect()), key=str)
        assert found == brute(rows, s)


def test_one_of_each_class_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, _h1 string")
    found = jaccard.one_of_each(df)
    assert found.columns == df.columns
    kept = [r["doc_id"] for r in found.collect()]
    expected = brute(rows, jaccard.Settings())
    classes = {c for i, c, *_ in expected if c is not None}
    # A row without an id stands for its class, so that of row 8 is kept by the null row.
    assert len(kept) == len(classes) + 1
    assert set(kept) - {None} <= classes
    assert jaccard.one_of_each(df.limit(0)).count() == 0
    assert jaccard.similar_texts(df.limit(0)).count() == 0


def test_pruning_bound_is_the_posterior():
    for n, m in ((24, 10), (48, 30), (240, 170)):
        assert abs(sum_tail(n, m, 0.8) - posterior(n, m, 0.8)) < 1e-6
    assert jaccard.least_agreements(240, 0.8, 1e-6) > 120


def sum_tail(n, m, t):
    from math import comb

    return sum(comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(m + 1))


def test_pruning_keeps_all_pairs_at_the_threshold():
    s, random_numbers = jaccard.Settings(), np.random.default_rng(0)
    left = random_numbers.integers(0, 1 << 32, (2000, s.size), np.uint32)
    right = np.where(random_numbers.random(left.shape) < 0.8, left, left + 1)
    i, _ = jaccard.surviving(left, right, (np.arange(2000), np.arange(2000)), s)
    assert len(i) == 2000
    i, _ = jaccard.surviving(left, np.where(random_numbers.random(left.shape) < 0.4, left, left + 1), (np.arange(2000), np.arange(2000)), s)
    assert len(i) == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)] + [(100, 101)]])
def test_components(spark, edges):
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    expected = {}
    for a, b in edges:
        if a != b:
            low = 100 if a >= 100 else 0
            expected[a] = expected[b] = low
    assert found == expected
