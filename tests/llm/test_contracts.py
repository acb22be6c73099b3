"""Registered queries without SQL, on the smallest tables, against brute force over whole tables."""

import base64
import hashlib
import struct
import zlib

import pytest
import public_tokenizers
import sentencepiece

from tardygrade.llm import catalog


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_encoding_equals_the_library(spark, sf, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = catalog.op1_sentencepiece(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        ids = library.encode(documents[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_repeats_equal_all_strings(spark, sf, documents):
    length, seen, wanted = 100, set(), {}
    for ident in sorted(documents):
        raw = documents[ident].encode()
        cut = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            own = raw[k : k + length]
            if own in seen:
                cut[k : k + length] = b"\1" * length
            seen.add(own)
        kept = bytes(b for b, c in zip(raw, cut) if not c)
        spans = sum(c and not (k and cut[k - 1]) for k, c in enumerate(cut))
        wanted[ident] = len(raw), sum(cut), spans, hashlib.sha256(kept).hexdigest()
    rows = catalog.op7_suffix_dedup(spark, sf).collect()
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert len(rows) == len(documents) and found == wanted


def test_archives_equal_the_pages(spark, sf):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    last = {}
    for ident, html in sorted(pages.items()):
        last[html] = ident
    rows = catalog.op8_warc(spark, sf).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        html = pages[r["page_id"]]
        first = last[html]
        assert r["payload_bytes"] == len(html)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(html).digest()).decode()
        revisit = first != r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if revisit else ("response", None))


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def test_rules_of_urls(spark, sf):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = catalog.op9_url_filter(spark, sf).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        rest = (pages[r["page_id"]] or "").partition("://")[2]
        upto = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
        host, rest = rest[:upto].lower(), rest[upto:]
        path = rest[: min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))]
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[1])
        assert r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == rule[2])


@pytest.mark.parametrize("query, folds, fold, limit", [("op2_quality", 4, 2, 0.7), ("op4_toxicity", 5, 0, 0.5)])
def test_folds_and_limits(spark, sf, documents, query, folds, fold, limit):
    rows = catalog.queries()[query](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)
