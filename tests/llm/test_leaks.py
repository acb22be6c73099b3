import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tardygrade.llm import leaks

WORDS = [f"w{chr(97 + k % 26)}{k}" for k in range(3000)]


def test_common_words_equals_the_table():
    choose = random.Random(1)
    for _ in range(200):
        a, b = ([choose.randrange(6) for _ in range(choose.randint(0, 20))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert leaks.common_words(a, b) == table[-1, -1]


@pytest.fixture(scope="module")
def found(spark):
    choose = random.Random(2)

    def prose(n):
        return choose.choices(WORDS, k=n)

    items = [(k, " ".join(prose(choose.randint(14, 55)))) for k in range(30)]
    items[3] = (3, " ".join(prose(20)) + ". The answer: " + " ".join(prose(8)) + ".")
    docs, planted = [], set()
    for k in range(120):
        words = prose(choose.randint(0, 300))
        if k % 4 == 0:
            item = choose.choice(items)
            inside = item[1].split()
            if k % 8 == 0:  # reworded: every seventh word is another one
                inside = [choose.choice(WORDS) if j % 7 == 5 else w for j, w in enumerate(inside)]
            at = choose.randint(0, len(words))
            words[at:at] = inside
            planted.add((k, item[0]))
        docs.append((k, " ".join(words)))
    # The question without its answer is no leak.
    docs.append((500, " ".join(prose(50)) + " " + items[3][1].split(". The")[0]))
    docs += [(501, None), (502, ""), (503, "one"), (504, " ".join(prose(40_000))), (None, items[5][1]), (0, docs[0][1])]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, words string")
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "...")], "item_id long, text string")
    return frame, bench, planted | {(None, 5)}


def test_planted_passages(found):
    docs, bench, planted = found
    rows = leaks.leaks(docs, bench).collect()
    assert len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows})
    assert {(r["doc_id"], r["item_id"]) for r in rows} == planted
    assert all(r["common"] >= 0.6 and r["cosine"] >= 0.55 for r in rows)


def test_items_in_blocks(found):
    docs, bench, planted = found
    rows = leaks.leaks(docs.filter("doc_id < 40"), bench, leaks.Settings(items=7)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {p for p in planted if p[0] is not None and p[0] < 40}


def test_rows_that_share_an_id(spark, found):
    others, bench, _ = found
    choose = random.Random(4)
    clean = [" ".join(choose.choices(WORDS, k=80)) for _ in range(2)]
    item = {r["item_id"]: r["text"] for r in bench.collect()}
    rows = [(None, clean[0]), (None, clean[0] + " " + item[7]), (None, item[7] + " " + clean[1]), (None, None), (None, "")]
    rows += [(900, clean[1]), (900, clean[1] + " " + item[9]), (900, clean[1] + " " + item[9])]
    docs = spark.createDataFrame([(*r, "new") for r in rows], others.schema).unionByName(others.filter("doc_id < 500"))
    docs = docs.withColumnRenamed("words", "leak_h1")
    hits = leaks.leaks(docs, bench).filter("doc_id is null or doc_id = 900").collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in hits) == [("900", 9), ("None", 7), ("None", 7)]
    kept = leaks.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    got = kept.filter("leak_h1 = 'new'").select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [rows[0], *rows[3:6]]))


def test_copies_in_a_small_corpus(spark, found):
    _, bench, _ = found
    choose = random.Random(4)
    clean = [" ".join(choose.choices(WORDS, k=80)) for _ in range(2)]
    item = {r["item_id"]: r["text"] for r in bench.collect()}
    rows = [(1, clean[0]), (2, clean[0] + " " + item[7]), (3, item[7] + " " + clean[1]), (4, clean[1] + " " + item[9])]
    hits = leaks.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in hits) == [(2, 7), (3, 7), (4, 9)]


def test_stage_keeps_clean_rows_of_a_leaking_id(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(None, "a clean text without an id", "en", "s", 1), (None, "intro words here " + bench, "en", "s", 2)]
    extra += [(9000, "a clean text with an id", "en", "s", 3), (9000, "other words here " + bench, "en", "s", 4)]
    out = corpus_pipeline.decontamination(spark, docs.unionByName(spark.createDataFrame(extra, docs.schema)), sf)
    kept = out.filter("doc_id is null or doc_id = 9000").select("n_chars").collect()
    assert sorted(r["n_chars"] for r in kept) == [1, 3]


def test_empty_tables(found):
    docs, bench, _ = found
    assert leaks.leaks(docs.limit(0), bench).count() == 0
    assert leaks.leaks(docs.limit(5), bench.limit(0)).count() == 0


def test_products_equal_the_matrix():
    s = leaks.Settings(terms=64, block=4, blocks=2)
    random_numbers = np.random.default_rng(0)
    sizes = np.array([0, 1, 3, 4, 5, 8, 9, 30])
    words = random_numbers.integers(-1000, 1000, sizes.sum()).astype(np.int32)
    passages = leaks.Passages(words, sizes, s)
    rows, ends = [], np.cumsum(sizes)
    for end, size in zip(ends, sizes):
        blocks = -(-size // 4)
        for b in range(max(1, blocks - 1) if size else 0):
            row = np.zeros(64)
            np.add.at(row, words[end - size + 4 * b : min(end, end - size + 4 * b + 8)] % 64, 1)
            rows.append(row)
    matrix = np.array(rows)
    right = random_numbers.normal(size=(64, 3))
    assert np.allclose(passages.sums(right), matrix @ right)
    assert np.allclose(passages.spread(matrix @ right), matrix.T @ (matrix @ right))


def test_words_in_common_equal_counting():
    choose, s = random.Random(6), leaks.Settings(block=4)
    few = WORDS[:40]
    items = [(k, " ".join(choose.choices(few, k=choose.randint(1, 30)))) for k in range(12)]
    lines = ["", "one", *(" ".join(choose.choices(few, k=choose.randint(1, 120))) for _ in range(15))]
    words, sizes = leaks.hashed_words(lines)
    space = leaks.LatentSpace(np.random.default_rng(0).normal(size=(s.terms, 4)).astype(np.float32), s)
    (own,) = leaks.Items.some(items, space)
    numbers, ends = own.numbered(words), np.cumsum(sizes)
    rows = [(t, i, p) for t in range(len(lines)) for i in range(len(own.ids)) for p in range(0, max(1, int(sizes[t])), 4)]
    text, item, place = (np.array(x) for x in zip(*rows))
    found = leaks._enough_in_common(numbers, sizes, own, text, item, place, s)
    low, high = leaks._region(place, sizes[text], own.sizes[item], s)
    for (t, i, _), a, z, got in zip(rows, low, high, found):
        region = Counter(words[ends[t] - sizes[t] :][a:z].tolist())
        common = sum((region & Counter(own.words[i])).values())
        assert got == (common >= s.least_common * len(own.words[i]))
    assert 0 < found.sum() < len(found)
    assert not len(leaks._enough_in_common(numbers, sizes, own, *[np.empty(0, np.int64)] * 3, s))


def test_words_of_many_texts_are_those_of_each():
    """Texts are hashed some at a time; empty ones and long ones stand between others."""
    from tardygrade.llm.leaks import hashed_words, word_hashes

    lines = [("word%d and, more " % k) * (k % 7 * 900) for k in range(40)] + ["", "...", "end"]
    hashes, sizes = hashed_words(lines)
    assert sizes.tolist() == [len(word_hashes(x)) for x in lines]
    assert hashes.tolist() == [w for x in lines for w in word_hashes(x)]
