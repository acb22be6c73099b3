"""One registered query for each text operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, leaks, phrases, pieces, quality, repeats, rules, sketches, toxicity, turns, urls, warc
from .oracles import ORACLES
from .common import crc_fold, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        pieces.ids_digest("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from three of four folds."""
    docs = read(spark, sf_dir, "documents")
    fold = F.coalesce(crc_fold("doc_id", 4), F.lit(0))
    model = quality.fit(docs, read(spark, sf_dir, "labels"), allowed=fold != 2)
    return quality.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items that they contain."""
    return leaks.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from four of five folds."""
    docs = read(spark, sf_dir, "documents")
    fold = F.coalesce(crc_fold("doc_id", 5), F.lit(1))
    net = toxicity.fit(docs, read(spark, sf_dir, "labels"), allowed=fold != 0)
    return toxicity.scored(docs.select("doc_id", "text"), net).select(
        "doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of each participant."""
    return chat.perspectives(read(spark, sf_dir, "conversations"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and whether it stays within the limits of its group."""
    return rules.judged(read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that occurred earlier."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.without_repeats(docs).select(
        "doc_id",
        "n_bytes",
        F.coalesce(F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"), F.lit(0)).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it comes back from the archives."""
    return warc.archived(read(spark, sf_dir, "pages"), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url."""
    return urls.judged(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "words", "log_odds")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of similar texts of every document."""
    return jaccard.similar_texts(read(spark, sf_dir, "documents"))


def op11_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of word pairs, and the component of near duplicates that it is in."""
    return sketches.near_duplicates(read(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with a fault in five of twenty turns; nulls of any column count as one blank."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(filled[0], F.lit(":"), filled[1]).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled[2].alias("role"), filled[3].alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")
    rows = rows.filter("fault != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies)
    return rows.drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    conversations = read(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    audited = turns.audits(rows)
    found = audited.drop("conv").join(turns.digests(rows, audited), "key")
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key")
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (
        conversations.select("conv_id", key)
        .distinct()
        .join(found, "key", "left")
        .select(
            "conv_id",
            *counts,
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words go together most."""
    return phrases.collocations(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_sentencepiece, op2_quality, op3_decontamination, op4_toxicity, op5_chat, op6_quality_rules, op7_suffix_dedup,
        op8_warc, op9_url_filter, op10_jaccard_join, op11_near_dedup, op12_repair, op13_phrases,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
