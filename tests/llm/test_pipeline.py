"""Queries with SQL against DuckDB, and the pipeline on a small corpus."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tardygrade.llm import catalog

TABLES = ("documents", "conversations", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    got = catalog.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})")
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_all_operators_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_strings", "decontamination", "encoding"]


def test_stages_keep_clean_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    base = "a clean text about stones rivers and trees that no other document has, with number "
    extra = [(9000 + k, base + " ".join(f"{k}{j}" for j in range(60)), None, None, None) for k in range(3)]
    extra += [(9100, extra[0][1], "en", "s", 1), (9101, extra[1][1] + " end", "en", "s", 1), (9102, "intro words here " + bench, "en", "s", 1)]
    extra += [(9103, None, None, None, None), (9104, "", "en", None, 0), (None, "a text without an id of its own", "en", "s", 5)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "encoding":
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert {9000, 9001, 9002, None} <= set(kept["encoding"])
    assert 9100 in kept["toxicity"] and not {9100, 9101} & set(kept["near_duplicates"])
    assert sorted(map(str, kept["repeated_strings"])) == sorted(map(str, kept["near_duplicates"]))
    assert 9102 not in kept["decontamination"]
    assert all(r["n_tokens"] == len(r["ids"]) for r in docs.collect())


def test_stages_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
