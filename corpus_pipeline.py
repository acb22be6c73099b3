"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, which is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``. Rows with a null doc_id, null or empty texts, repeated rows and further columns
are allowed; an empty table gives an empty result.

1. ``toxicity`` drops documents whose score reaches 0.5. It learns from the labels of the
   documents that it is given, those of the query's held-out fold left out.
2. ``near_duplicates`` keeps one document of each class of similar texts, the one with the
   smallest doc_id; of equal rows one is kept.
3. ``repeated_strings`` cuts out strings of 100 bytes that stand earlier in the corpus. A
   character that is cut in part stays. All documents are kept, also those left empty.
4. ``decontamination`` drops rows whose own text contains a benchmark passage; other texts
   with the same doc_id, or with a null one, stay.
5. ``encoding`` returns doc_id, lang, source, the token ids with begin and end, their number,
   and the decoded text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tardygrade.llm import jaccard, leaks, pieces, repeats, toxicity
from tardygrade.llm.common import crc_fold, fresh, read
from tardygrade.session import shared_folder

# No SQL: the first stage is a trained model.
ORACLE_SQL = None


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fold = F.coalesce(crc_fold("doc_id", 5), F.lit(1))
    net = toxicity.fit(docs, read(spark, sf_dir, "labels"), allowed=fold != 0)
    score = fresh(docs, "toxic_score")
    return toxicity.scored(docs, net, out=score).filter(F.col(score) < 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.cut_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.without_leaks(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Workers of the stages before may still be there, so each remembers fewer words.
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.round_trip(docs.select("doc_id", "lang", "source", "text"), model, memory=1 << 18)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
