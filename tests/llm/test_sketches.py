import random

import numpy as np

from tardygrade.llm import sketches
from tardygrade.llm.sketches import Settings


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text, width=2):
    w = words_of(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all texts."""
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    out = []
    for k, (ident, _) in enumerate(rows):
        ids = [r[0] for r, p in zip(rows, part) if p == part[k] and r[0] is not None]
        component = min(ids, default=None) if sets[k] else ident
        out.append((ident, len(sets[k]), component, component == ident))
    return sorted(out, key=str)


def corpus():
    choose = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for family in range(5):
        base = choose.choices(words, k=choose.randint(40, 90))
        for copy in range(14):
            # Chains of copies: each is near the one before, and not always near the first.
            for _ in range(choose.randint(1, 3)):
                base[choose.randrange(len(base))] = choose.choice(words)
            rows.append((len(rows), " ".join(base)))
    odd = ["", None, " \n\t", "one", "ONE", "one two", "One\x0btwo\r", "ONE two three", "É one", "é one", "a b " * 20_000, "A B\n" * 5, rows[3][1]]
    rows += [(len(rows) + k, t) for k, t in enumerate(odd)]
    rows += [(5, rows[5][1]), (5, "another text with the same id"), (None, rows[8][1]), (None, "nobody knows this one"), (None, ""), (None, "x" * 200_000)]
    choose.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, node int, component_id string").repartition(5)
    for s in (Settings(), Settings(block=3)):
        found = sketches.near_duplicates(df, s=s)
        assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_empty_tables_and_texts(spark):
    kind = "doc_id long, text string"
    assert sketches.near_duplicates(spark.createDataFrame([], kind)).collect() == []
    found = sketches.near_duplicates(spark.createDataFrame([(2, None), (1, ""), (2, None)], kind)).collect()
    assert sorted(map(tuple, found)) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)]


def test_ids_of_other_types(spark):
    rows = [("b", "one two three"), ("a", "One two  three"), ("c", "four five")]
    found = sketches.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(map(tuple, found)) == [("a", 2, "a", True), ("b", 2, "a", False), ("c", 1, "c", True)]


def by_rounds(values, size):
    """The sketch, a round and a shingle at a time."""
    factor, shift = sketches._throws(size)
    found = [None] * size
    for r in range(2 * size):
        now = {}
        for x in values:
            with np.errstate(over="ignore"):
                h = int(sketches.mixed(np.array([x * factor[r, 0] + shift[r, 0]], np.uint64))[0])
            at = (h >> 32) * size >> 32 if r < size else r - size
            now[at] = min(now.get(at, 1 << 64), r << 32 | h & 0xFFFFFFFF)
        for at, value in now.items():
            if found[at] is None:
                found[at] = value
        if None not in found:
            break
    return found


def test_sketch_is_filled_in_rounds():
    numbers = np.random.default_rng(1)
    for n in (1, 2, 7, 40, 900):
        values = np.unique(numbers.integers(0, 1 << 64, n, np.uint64))
        assert sketches.sketch(values, 12).tolist() == by_rounds(values, 12)


def test_agreements_are_concentrated_around_the_similarity():
    numbers = np.random.default_rng(2)
    s, shares, bands = Settings(), [], 0
    for n in (9, 90, 900):
        for _ in range(60):
            x = numbers.integers(0, 1 << 64, n + n // 9 * 2, np.uint64)
            # 8/9 n shared of n + n/9 in all: a similarity of 0.8.
            a, b = (sketches.short(sketches.sketch(np.unique(part), s.size)) for part in (x[:n], x[n // 9 : n // 9 * 10]))
            equal = int((a == b).sum())
            assert equal >= sketches.least_equal(s.size, s.percent, s.miss)
            shares.append(equal / s.size)
            keys = sketches.band_keys(np.stack([a, b]), s)
            bands += bool((keys[0] == keys[1]).any())
    assert abs(np.mean(shares) - 0.8) < 0.01 and bands == len(shares)


def test_texts_are_hashed_in_parts(monkeypatch):
    texts = ["a b c", None, "", "Word " * 3000, "x" * 5000, "one two one two"]
    whole = [x.tolist() for x in sketches.shingle_sets(texts, 2)]
    monkeypatch.setattr(sketches, "WINDOW", 50)
    assert [x.tolist() for x in sketches.shingle_sets(texts, 2)] == whole
    assert [len(x) for x in whole] == [len(shingles(t)) for t in texts]


def test_one_large_group_of_copies(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base[:100], f"own{k}", *base[101:]])) for k in range(1500)] + [(2000 + k, " ".join(base)) for k in range(500)]
    found = sketches.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r["component_id"] for r in found} == {0} and len(found) == 2000
