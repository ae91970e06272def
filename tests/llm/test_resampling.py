"""Importance resampling: against a plain version, awkward rows, ties, hot rows, and the law of the draws."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.conftest import DATA
from tests.llm.test_text_operators import AWKWARD, LONG, SCHEMA
from tidemark.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, order):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)], len(words)


def plain_version(docs, target, order=1, buckets=10_000, percent=10, least=20, seed=2024):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) pairs, by dictionaries."""
    of = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(of, features(text, order)[0]))
    for text in target:
        t.update(map(of, features(text, order)[0]))
    whole, goal = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * whole / ((s[b] + 1) * goal))) for b in s}
    rows = []
    for doc_id, text in docs:
        found, n_words = features(text, order)
        weight = sum(gain[of(x)] for x in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, n_words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[2], r[1]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return Counter(tuple(r[:5]) for r in rows)


def result(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["the", "Of", "É", "é", "x9", "日本", "a-b", "w1", "w2", "tail"], int(n))) for n in rng.integers(0, 90, 300)]
    return [(int(i), t) for i, t in enumerate(texts)], ["the tail of w1", None, "", "É é tail", "w1 w1"]


@pytest.mark.parametrize("options", [{}, {"order": 3, "buckets": 97, "percent": 37, "least": 5, "seed": 7}, {"percent": 100, "least": 0}, {"percent": 0}])
def test_equals_plain_version(spark, corpus, options):
    docs, goals = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = resampling.resample_documents(df, spark.createDataFrame([(t,) for t in goals], "text string"), **options)
    assert result(got) == plain_version(docs, goals, **options)


def test_awkward_hot_and_repeated_rows(spark):
    """A third of all rows share id and text, nulls and very long texts among the rest; ranks are 1, 2, 3 ... without gaps."""
    rows = [*AWKWARD, *[(8, "one and the same text " * 9, "en", "s", 1, "x")] * 300, *[(None, "no id but many words " * 7, "en", "s", 1, "x")] * 300]
    rows += [(k, f"word{k % 7} and more of it " * 6, "en", "s", 1, "x") for k in range(100, 400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    goals = spark.createDataFrame([(1, "one and the same"), (2, LONG)], "item_id long, text string")
    got = resampling.resample_documents(docs, goals, percent=60)
    assert result(got) == plain_version([r[:2] for r in rows], ["one and the same", LONG], percent=60)
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 60 * sum(len(features(r[1], 1)[0]) >= 20 for r in rows) // 100


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(AWKWARD, SCHEMA), spark.createDataFrame([], "text string")
    assert resampling.resample_documents(docs.limit(0), docs).count() == 0
    assert result(resampling.resample_documents(docs, none)) == plain_version([r[:2] for r in AWKWARD], [])


def test_draws_follow_the_weights(spark):
    """Documents of a bucket twice as frequent in the target are drawn about twice as often, over many seeds."""
    weight = {0: 0, 1: round(1000 * math.log(2))}
    arrays = spark.createDataFrame([(k, 30, [k % 2]) for k in range(4000)], "doc_id long, n_words int, buckets array<int>")
    drawn = Counter()
    for seed in range(6):
        scored = resampling.score_documents(arrays, [weight[0], weight[1]], seed)
        ranked = resampling.rank_draws(scored, resampling.cutoff_of(scored, 5))
        drawn.update(r.doc_id % 2 for r in ranked.where("rank is not null").collect())
    assert sum(drawn.values()) == 6 * 200 and abs(drawn[1] / drawn[0] - 2) < 0.35


def test_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as from '{DATA}/sf0.001/{name}.parquet'")
    want = Counter(con.execute(f"select doc_id, n_features, weight, score, rank from ({resampling.ORACLE_SQL})").fetchall())
    tables = (spark.read.parquet(f"{DATA}/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    assert result(resampling.resample_documents(*tables)) == want
