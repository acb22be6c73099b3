import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tardygrade.llm import repeats
from tardygrade.llm.rindex import later_occurrences

LENGTH = repeats.Settings().length


def brute(rows):
    """(n_bytes, removed ranges, kept) of each row in corpus order, by looking at every string."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - LENGTH + 1):
            string = raw[k : k + LENGTH]
            if string in seen:
                gone[k : k + LENGTH] = b"\1" * LENGTH
            seen.add(string)
        edges = [k for k in range(len(raw) + 1) if (gone[k - 1] if k else 0) != (gone[k] if k < len(raw) else 0)]
        out.append((len(raw), list(zip(edges[::2], edges[1::2])), bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def corpus():
    choose = random.Random(8)
    words = ["the", "of", "ünder", "größe", "a", "straße", "and", "日本語", "runs"]

    def prose(n):
        return " ".join(choose.choice(words) + str(choose.randrange(90)) for _ in range(n))

    shared, line = prose(60), "a line that many documents have in common, but which is short"
    rows = []
    for k in range(60):
        parts = [prose(choose.randint(0, 40)), choose.choice(["", shared, shared[: choose.randint(50, 400)], line]), prose(choose.randint(0, 30))]
        rows.append((k, "\n".join(parts)))
    rows += [(60, None), (61, ""), (62, "x" * 99), (63, "x" * 350), (64, "x" * 99), (65, rows[3][1]), (66, rows[3][1]), (67, "ab" * 4000)]
    rows += [(68, prose(30_000)), (69, "12345 " * 30)]
    return rows


@pytest.mark.parametrize(
    "settings",
    [
        repeats.Settings(),
        repeats.Settings(slice_bytes=3000, block_bytes=500),
        repeats.Settings(slice_bytes=1500, hot_slices=2),
        repeats.Settings(gram=60, slice_bytes=5000),
    ],
)
def test_equals_brute_force(spark, settings):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, slice string, n_bytes int")
    found = repeats.without_repeats(df.repartition(5), s=settings)
    assert set(found.columns) == {"doc_id", "text", "slice", "n_bytes", "spans", "kept"}
    got = {r["doc_id"]: (r["n_bytes"], [tuple(x) for x in r["spans"]], bytes(r["kept"])) for r in found.collect()}
    for (i, _), expected in zip(rows, brute(rows)):
        assert got[i] == expected, i


def test_more_than_104_partitions(spark):
    rows = corpus()
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 240), "doc_id long, text string")
    found = repeats.without_repeats(df, s=repeats.Settings(slice_bytes=1500, hot_slices=2))
    got = {r["doc_id"]: (r["n_bytes"], [tuple(x) for x in r["spans"]], bytes(r["kept"])) for r in found.collect()}
    for (i, _), expected in zip(rows, brute(rows)):
        assert got[i] == expected, i


@pytest.mark.parametrize("partition", [0, 103, 104, 5000, (1 << 31) - 1])
def test_slices_of_any_partition_send_their_windows(partition):
    s, raw = repeats.Settings(), corpus()[68][1].encode()
    anchor = np.unique(repeats.windows(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), s)[3] & ~np.int64(1))
    blob = repeats._pack(pa.table({"text": [raw.decode()]}))
    left = pa.table({"slice": [partition << 32], "ids": [[1]], "h1": [[1]], "h2": [[1]], "blob": [blob]})
    salts = np.full(len(anchor), 3, np.int32)
    right = pa.table({"copies": [None], "anchors": [anchor.tobytes()], "salts": [salts.tobytes()]})
    sent = repeats._windows("text", 8, s)(left, right)
    assert set(sent.column("salt").to_pylist()) < {0, 1, 2} and sum(map(len, sent.column("docs").to_pylist())) >= len(anchor)


def test_cut_texts_keep_whole_characters(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    found = repeats.cut_texts(df)
    assert found.schema == df.schema
    got = {r["doc_id"]: r["text"] for r in found.collect()}
    for (i, text), (_, spans, kept) in zip(rows, brute(rows)):
        assert len(got[i].encode()) >= len(kept)
        assert len(got[i].encode()) - len(kept) <= 6 * len(spans)
        if not spans:
            assert got[i] == (text or "")


def test_rows_that_share_an_id(spark):
    text = "one two three four five six seven eight nine ten " * 4
    rows = [(1, text), (1, text), (None, text), (None, None)]
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # One row keeps its text (its own inner repeats are cut), the copies lose all of theirs.
    assert sorted(len(r["kept"]) > 0 for r in found) == [False, False, False, True]
    assert [r["doc_id"] for r in found if len(r["kept"])] == [None]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.without_repeats(df).count() == 0 and repeats.cut_texts(df).count() == 0


@pytest.mark.parametrize("length", [3, 5, 10, 100])
def test_index_finds_later_occurrences(length):
    choose = random.Random(length)
    for _ in range(40):
        letters = choose.choice(["ab", "abc", "abcdefgh"])
        base = ["".join(choose.choice(letters) for _ in range(choose.randint(length, 4 * length))) for _ in range(3)]
        strings = [(b[choose.randrange(len(b)) :] + choose.choice(["", *base])).encode() for b in choose.choices(base, k=choose.randint(1, 12))]
        found, seen = later_occurrences(strings, length), set()
        for string, offsets in zip(strings, found):
            expected = []
            for k in range(len(string) - length + 1):
                if string[k : k + length] in seen:
                    expected.append(k)
                seen.add(string[k : k + length])
            assert offsets.tolist() == expected


def test_digest_of_the_rest(spark):
    df = spark.createDataFrame([(1, "short")], "doc_id long, text string")
    row = repeats.without_repeats(df).first()
    assert hashlib.sha256(row["kept"]).hexdigest() == hashlib.sha256(b"short").hexdigest() and row["spans"] == []
