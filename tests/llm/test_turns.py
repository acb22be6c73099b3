import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tardygrade.llm import turns
from tardygrade.llm.catalog import damaged, op12_repair
from tardygrade.llm.turns import CUT_SHORT, DOOMED, Settings, code_of

AFTER = {"": "us", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, edits, final roles) of rows (role, text, fault), by trying all edits."""

    @lru_cache(None)
    def go(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        steps = []
        for role in AFTER[state]:
            if inserted < 2 and role != "s":
                steps.append((2, "I", go(i, role, inserted + 1)))
        if i < len(rows):
            steps.append((3, "D", go(i + 1, state, 0)))
            role, _, fault = rows[i]
            if fault not in ("blank", "duplicate"):
                for own in AFTER[state]:
                    more = fault == "truncated"
                    if role[:1] == own:
                        steps.append((more, "K", go(i + 1, own, 0)))
                    elif own != "s":
                        steps.append((2 + more, "R", go(i + 1, own, 0)))
        return min([*found, *((cost + rest[0], edit + rest[1]) for cost, edit, rest in steps if rest)], default=None)

    return go(0, "", 0)


def audited(rows):
    """The row of one conversation as the contract has it, from its rows (turn, role, text) after damage."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    known = [t for t, _, _ in rows if t is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "fine" if last in ".!?" else "truncated")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, edits = cheapest(tuple((r, x, f) for (_, r, x), f in zip(rows, faults)))
    out, at = [], 0
    for edit in edits:
        role, text = rows[at][1:] if edit != "I" else ("", "")
        at += edit != "I"
        if edit in "IR":
            role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit != "D":
            out.append((role, text, edit))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x, _ in out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, digest), out


def conversations():
    choose = random.Random(3)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(choose.choice([0, 1, 2, 5, 8, 8, 90 if conv == 7 else 9])):
            role = choose.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "under"])
            text = choose.choice([None, "", " \t", "Yes.", "No", "Why? ", "é!\n", f"text {conv} {turn}", f"text {turn}."])
            rows.append((conv, choose.choice([turn, turn, turn * 3, None, 2]), role, text))
    rows += [(41, 0, "user", "x" * 300_000 + "."), (41, 1, "assistant", " " * 100_000), (42, 5, "s", "only."), (43, 1, "assistant", "a.")]
    return rows + rows[5:9]


KIND = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("s", [Settings(), Settings(chunk=3, piece=2)])
def test_audits_and_repairs_equal_brute_force(spark, s):
    rows = conversations()
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], KIND + ", conv int, key string").repartition(6)
    found = turns.audits(df, s=s)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    digest = {r["key"]: r["sha256"] for r in turns.digests(df, found).collect()}
    got = {r["conv"]: (*(r[n] for n in names), digest[r["key"]]) for r in found.collect()}
    repaired = {}
    for r in sorted(turns.repaired(df, found).collect(), key=lambda r: r["place"]):
        repaired.setdefault(r["conv"], []).append((r["role"], r["text"], r["edit"]))
        assert r["place"] == len(repaired[r["conv"]]) - 1
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        want, out = audited([r[1:] for r in rows if r[0] == conv])
        assert got[conv] == want
        assert repaired.get(conv, []) == out


def test_empty_table(spark):
    df = spark.createDataFrame([], KIND)
    found = turns.audits(df)
    assert found.collect() == [] and turns.digests(df, found).collect() == [] and turns.repaired(df, found).collect() == []


@pytest.mark.parametrize("chunk", [5, 32, 64])
def test_long_conversations_are_joined_from_chunks(chunk):
    choose = random.Random(chunk)
    for _ in range(12):
        rows = tuple((choose.choice(["user", "assistant", "user", "system", "x"]), "", choose.choice(["fine"] * 5 + ["blank", "truncated"])) for _ in range(60))
        fault = {"fine": 0, "truncated": CUT_SHORT, "blank": DOOMED}
        codes = bytes(code_of(r[:1], fault[f]) for r, _, f in rows)
        assert turns.whole(turns.aligned_piece(codes, "", Settings(chunk=chunk))) == cheapest(rows)


def test_the_query_returns_every_conversation(spark, sf, tmp_path):
    rows = conversations() + [(1000 + k, None, None, None) for k in range(60)]
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: tuple(r)[1:] for r in op12_repair(spark, str(tmp_path)).collect()}
    after = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        after[conv] += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    assert any(not left for left in after.values())
    assert found == {conv: audited(left)[0] for conv, left in after.items()}
    assert damaged(spark.createDataFrame([], KIND)).count() == 0
