"""Python workers are used again by later stages: what one partition's work kept must not stay in them."""

from __future__ import annotations

import pyarrow as pa

from tidemark.llm import bpe, decontaminate, hashing, near
from tidemark.llm.queries import VOCABULARY


def kept(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(hashing._hashes)] * batch.num_rows), pa.array([len(decontaminate._tokens)] * batch.num_rows)], ["words", "tokens"])


def test_nothing_is_kept_after_a_partition(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(300))) for i in range(200)], "doc_id long, text string").repartition(4)
    assert len(near._signed(docs, near.WIDTH, 128).select('size').collect()) == 200
    left = spark.range(0, 400, 1, 4).mapInArrow(kept, "words long, tokens long").agg({"words": "max", "tokens": "max"}).first()
    assert max(left) < 100


def test_a_codec_drops_its_words_with_the_partition(spark, monkeypatch):
    made = []

    class Stub:
        value = bpe._Definition(open(VOCABULARY, encoding="utf-8").read())

    class Docs:
        sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda d: Stub)})})

        def selectExpr(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            made.append(run)

    bpe.encode_documents(Docs(), VOCABULARY)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words to encode"])], ["doc_id", "text"])
    for out in made[0]([batch]):
        assert out.column("decoded")[0].as_py() == "some words to encode"
        assert Stub.value.codec().cache
    assert not Stub.value.codec().cache
