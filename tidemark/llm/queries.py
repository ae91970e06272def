"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, chat, decontaminate, fingerprints, infill, language, licences, near, quality, resampling, secrets, toxicity, urls

#: Where the vocabulary of op10 lies, on the driver.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(chat.PROBE, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(chat.as_parts(rows.unionByName(probe))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit_documents(docs, table(spark, sf_dir, "labels")))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(table(spark, sf_dir, "pages"), urls.page_labels(table(spark, sf_dir, "labels")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_documents(table(spark, sf_dir, "documents"))


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify_documents(docs, language.fit_documents(docs))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY, digests=True)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rules")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_documents(table(spark, sf_dir, "documents"), digests=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": op1_chat,
        "op2_toxicity": op2_toxicity,
        "op3_urls": op3_urls,
        "op4_secrets": op4_secrets,
        "op5_decontaminate": op5_decontaminate,
        "op6_licences": op6_licences,
        "op7_near": op7_near,
        "op8_language": op8_language,
        "op9_fingerprints": op9_fingerprints,
        "op10_bpe": op10_bpe,
        "op11_quality": op11_quality,
        "op12_resampling": op12_resampling,
        "op13_infill": op13_infill,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat": chat.ORACLE_SQL,
        "op4_secrets": secrets.oracle(),
        "op11_quality": quality.oracle(),
        "op12_resampling": resampling.ORACLE_SQL,
        "op13_infill": infill.ORACLE_SQL,
    }
