"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Stages take (spark, docs, sf_dir). All but the last return the columns of their input; the last returns
one row of token ids per document that is left.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, language, near, secrets
from tidemark.llm.queries import VOCABULARY, table
from tidemark.llm.storage import shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go, among them null texts and texts without letters."""
    return language.keep_identified(docs, language.fit_documents(docs))


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    return near.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or re-parameterised, go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are taken out of the texts; every document stays."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, as little-endian unsigned 32-bit integers, and the text they decode to."""
    return bpe.encode_documents(docs, VOCABULARY)


STAGES = [
    ("language", identify_language),
    ("near", join_near),
    ("decontamination", decontaminate_benchmark),
    ("secrets", scan_secrets),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, with a Parquet table in the shared folder between each two."""
    base = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if number + 1 == len(STAGES):
            return result
        result.write.parquet(f"{base}/{number}-{name}")
        docs = spark.read.parquet(f"{base}/{number}-{name}")
    return docs


#: A trained model decides in the first stage, so there is no SQL; a brute-force version is tested.
ORACLE_SQL = None
