"""Every operator gives the same for a table with further columns that carry names it uses inside, and for
nulls, empty and very long texts, ties, repeated rows and empty tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import AWKWARD, PATH, SCHEMA
from tidemark.llm import bpe, chat, decontaminate, fingerprints, infill, language, licences, near, quality, resampling, secrets, toxicity, urls

NAMES = (
    "content whole spans _blob row rep set_key sig size items _items coverage hash at own other k run guest key ids tokens words toxic n "
    "label labels bad template open name kind segment salt host path found new pairs seen n_rows pairs_ item place share class_key links root node "
    "host_rules large kept n_words buckets weight score copies upto above rank output form"
).split()


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([*AWKWARD, (9, "the of and to in the of and to in", "en", "s", 30, None)] * 2, SCHEMA).drop("blob")
    pages = spark.createDataFrame([(1, "http://a.org/x/1"), (1, "http://a.org/x/1"), (None, None), (2, "nothing"), (3, "")], "page_id long, url string")
    talks = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (None, None, None, "x"), (2, 0, "user", "long " * 50_000)], "conv_id long, turn long, role string, text string")
    return {"docs": docs, "pages": pages, "talks": talks}


@pytest.fixture(scope="module")
def models(spark):
    rows = [(k, ("the of and to in" if k % 2 else "le la les des est"), ("en", "fr")[k % 2]) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chain = toxicity.fit_documents(docs, spark.createDataFrame([(k, int(k % 2)) for k in range(80)], "doc_id long, toxic int"))
    bench = spark.createDataFrame([(1, "tie and more of this one item here"), (2, "tie"), (None, None)], "item_id long, text string")
    return {"language": language.fit_documents(docs), "chain": chain, "bench": bench, "labels": spark.createDataFrame([(1, 1), (None, 0)], "page_id long, bad int")}


WORK = {
    "op1": ("talks", lambda d, m: chat.digests(chat.format_conversations(chat.as_parts(d)))),
    "op2": ("docs", lambda d, m: toxicity.score_documents(d, m["chain"])),
    "op3": ("pages", lambda d, m: urls.judge_pages(d, m["labels"])),
    "op4": ("docs", lambda d, m: secrets.report(d)),
    "op4_redact": ("docs", lambda d, m: secrets.redact(d)),
    "op5": ("docs", lambda d, m: decontaminate.judge_documents(d, m["bench"])),
    "op5_keep": ("docs", lambda d, m: decontaminate.keep_clean(d, m["bench"])),
    "op6": ("docs", lambda d, m: licences.scan_documents(d)),
    "op7": ("docs", lambda d, m: near.near_classes(d).select("doc_id", "class_id", "n_links")),
    "op7_keep": ("docs", lambda d, m: near.keep_one(d)),
    "op8": ("docs", lambda d, m: language.identify_documents(d, m["language"])),
    "op8_keep": ("docs", lambda d, m: language.keep_identified(d, m["language"])),
    "op9": ("docs", lambda d, m: fingerprints.fingerprint_documents(d)),
    "op10": ("docs", lambda d, m: bpe.encode_documents(d, PATH)),
    "op11": ("docs", lambda d, m: quality.judge_documents(d)),
    "op12": ("docs", lambda d, m: resampling.resample_documents(d, m["bench"])),
    "op13": ("docs", lambda d, m: infill.infill_documents(d)),
}


@pytest.mark.parametrize("name", WORK)
def test_clashing_names_and_empty_tables(tables, models, name):
    which, work = WORK[name]
    table = tables[which]
    more = table.select("*", *(F.lit(f"extra {n}").alias(n) for n in NAMES if n not in table.columns))
    plain, clash = work(table, models), work(more, models)
    if name in ("op4_redact", "op5_keep", "op7_keep", "op8_keep"):
        assert clash.columns == more.columns
        assert {r[n] for r in clash.collect() for n in ("content", "whole", "_blob")} <= {"extra content", "extra whole", "extra _blob"}
    got = Counter(map(repr, clash.select(*plain.columns).collect()))
    assert got == Counter(map(repr, plain.collect())) and got
    if name not in ("op1",) and not name.endswith("keep"):
        assert sum(got.values()) == table.count()
    empty = work(table.limit(0), models)
    assert empty.schema == plain.schema and empty.count() == 0
