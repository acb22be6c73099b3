import random
import re
from collections import Counter

import numpy as np
import pytest

from tardygrade.llm import phrases
from tardygrade.llm.phrases import Settings


def brute(rows, s):
    """All columns by counting every phrase."""
    found = []
    for lang in {r[0] or "und" if r[0] is not None else "und" for r in rows}:
        f, n = Counter(), 0
        for own, text in rows:
            if (own if own is not None else "und") != lang:
                continue
            lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                for size in range(1, s.longest + 1):
                    f.update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= s.least}
        listed = []
        for p, a in candidates.items():
            inside = any(
                len(q) > len(p) and 100 * b >= s.share * a and any(q[k : k + len(p)] == p for k in range(len(q)))
                for q, b in candidates.items()
            )
            if not inside:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                listed.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], n, score))
        for rank, x in enumerate(sorted(listed)[: s.top], 1):
            found.append((lang, rank, x[2].decode(), *x[3:]))
    return sorted(found)


def corpus():
    choose = random.Random(5)
    words = [f"w{k}" for k in range(12)] + ["Über", "über", "é" * 40, "long" * 30, "#a", "(b)"]
    rows = []
    for k in range(120):
        text = "".join(choose.choice(words) + choose.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(choose.randint(0, 60)))
        rows.append((choose.choice(["en", "en", "en", "de", None, "und"]), text))
    fixed = "New York City hall is in new york city; "
    return rows + [("en", fixed * 9), ("en", fixed * 9), ("en", None), (None, ""), ("fr", "seul"), ("de", "A a A a " * 200)]


SMALL = [
    Settings(least=4),
    Settings(least=4, top=7, dense=1, tile=2, grid=1, buffer=50),
    Settings(least=3, block=5, dense=4, tile=1, grid=2),
    Settings(least=2, share=50, longest=3),
]


@pytest.mark.parametrize("s", SMALL)
def test_phrases_equal_brute_force(spark, s):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, id int, phrase string").repartition(4)
    found = phrases.collocations(df, s=s)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, s)


def test_empty_tables_and_rare_words(spark):
    kind = "lang string, text string"
    assert phrases.collocations(spark.createDataFrame([], kind)).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "a b c")], kind)).collect() == []


def test_parts_of_a_long_text(spark, monkeypatch):
    text = ("alpha beta gamma " * 400 + "delta, ") * 3
    df = spark.createDataFrame([("en", text)], "lang string, text string")
    whole = phrases.collocations(df).collect()
    assert len(list(phrases.windows(text.encode(), 100))) > 100
    monkeypatch.setattr(phrases, "windows", lambda raw: list(_windows(raw, 100)))
    batch = next(phrases._by_language(df.toArrow().to_batches()))
    parts = list(batch[1])
    assert len(parts) > 100 and sum(len(p.hashes) for p in parts) == len(re.findall(r"[^\s,]+", text))
    assert sorted(map(tuple, whole)) == brute([("en", text)], Settings())


_windows = phrases.windows


@pytest.mark.parametrize("s", [Settings(), Settings(tile=2, grid=2, dense=3), Settings(tile=1, grid=1, dense=1)])
def test_tiles_count_every_code(s):
    numbers = np.random.default_rng(3)
    codes = np.concatenate(
        [(numbers.zipf(1.3, 4000) % 5000) << 32 | (numbers.zipf(1.3, 4000) % 5000), numbers.integers(0, 1 << 62, 50) & ~np.int64(1 << 31)]
    ).astype(np.int64)
    keys, counts = phrases.tile_counts(codes, s)
    assert dict(zip(keys.tolist(), counts.tolist())) == Counter(codes.tolist())
    assert len(keys) == len(set(keys.tolist()))


def test_scores_are_exact_beyond_64_bits(spark):
    a, x, y = 9 * 10**15, 9 * 10**15 + 7, 10**16 + 3
    row = spark.createDataFrame([(a, x, y)], "a long, x long, y long").select(phrases._cut(1, "x", "y").alias("c")).first()["c"]
    assert row["score"] == 2_000_000 * a // (x + y) and 2_000_000 * a > 1 << 64


@pytest.mark.parametrize("s", SMALL[:1] + SMALL[2:3])
def test_one_python_process_for_each_running_task(spark, s, monkeypatch):
    """Each Arrow function of a plan has a process of its own for each running task, which is an executor's memory."""
    plans, write = [], phrases.materialize

    def seen(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(phrases, "materialize", seen)
    phrases.collocations(spark.createDataFrame(corpus(), "lang string, text string"), s=s)
    counts = [plan.count("MapInArrow") for plan in plans]
    assert sum(counts) >= 5 and max(counts) == 1
