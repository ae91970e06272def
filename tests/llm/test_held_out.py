"""Learned operators on the given documents: held-out accuracy, and models that do not depend on the order of rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.llm import language, toxicity

SF = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_of_held_out_documents(docs):
    """Documents that no model learns from, whole: nearly all get their language, and those that are rejected are few."""
    model = language.fit_documents(docs)
    found = language.identify_documents(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    r = found.agg(F.count("*").alias("n"), F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("right")).first()
    assert r.n > 100 and r.right > 0.97
    assert language.keep_identified(docs, model).count() > 0.97 * docs.count()


def test_toxicity_of_documents_without_label_in_the_fit(spark):
    """Half of the labels train, the other half tells what was caught and what was left alone."""
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    learn = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    chain = toxicity.fit_documents(docs, labels.where(learn))
    judged = toxicity.score_documents(docs, chain).join(labels.where(~learn).select("doc_id", F.col("toxic").alias("truth")), "doc_id")
    r = {x.truth: x.share for x in judged.groupBy("truth").agg(F.avg(F.col("toxic").cast("double")).alias("share")).collect()}
    assert r[1] > 0.8 and r[0] < 0.05


def test_model_of_repeated_ids_does_not_depend_on_the_order(spark):
    rows = [(k % 40, f"{'vile awful' if k % 4 == 0 else 'calm kind'} text number {k}") for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(40)], "doc_id long, toxic int")
    chains = [toxicity.fit_documents(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 7))]
    assert chains[0].threshold == chains[1].threshold
    probe = spark.createDataFrame([(1, "vile text"), (2, "kind text")], "doc_id long, text string")
    assert [toxicity.score_documents(probe, c).collect() for c in chains][0] == toxicity.score_documents(probe, chains[1]).collect()
