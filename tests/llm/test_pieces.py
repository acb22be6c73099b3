import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tardygrade.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "th", "e", "ing", "▁", "é", "日本", "😀", "\t", "<s>", "<0x41>", "aaa", "    ", "\x00", "ẑ", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_encoding_equals_the_library(library):
    table, choose = pieces.PieceTable(MODEL), random.Random(1)
    vocabulary = list(table.ids)
    for k in range(4000):
        source = PARTS if k % 2 else vocabulary
        text = "".join(choose.choice(source) for _ in range(choose.randint(0, 25)))
        assert np.frombuffer(table.encode(text), "<i4").tolist() == library.encode(text), repr(text)


def test_decoding_equals_the_library(library):
    table, choose = pieces.PieceTable(MODEL), random.Random(2)
    for _ in range(3000):
        ids = [choose.choice([choose.randint(0, 31999), choose.randint(3, 258)]) for _ in range(choose.randint(0, 9))]
        assert table.decode(ids) == library.decode(ids), ids


def test_small_memory_changes_nothing(library):
    table = pieces.PieceTable(MODEL, memory=3)
    text = "the cat sat on the mat, then the cat left " * 5
    assert np.frombuffer(table.encode(text), "<i4").tolist() == library.encode(text)


def test_columns(spark, library):
    rows = [(1, "the cat", "x"), (2, None, "y"), (2, None, "y"), (None, "", "z"), (3, "long " * 50_000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = pieces.round_trip(df, MODEL).withColumn("sha", pieces.ids_digest("ids")).collect()
    assert len(found) == 5
    for row in found:
        ids = library.encode(row["text"] or "", add_bos=True, add_eos=True)
        assert row["ids"] == ids and row["decoded"] == (row["text"] or "")
        assert row["sha"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert pieces.round_trip(df.limit(0), MODEL).count() == 0
