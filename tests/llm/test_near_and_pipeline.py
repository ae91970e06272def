"""The similarity join, connected components and the pipeline against brute force."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import components, language, near
from tidemark.llm.queries import VOCABULARY
from tests.llm.test_text_operators import brute_leaks, brute_spans


def shingles(text: str | None) -> set:
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(texts: list[str | None], threshold: float = 0.8) -> tuple[list[int], list[int]]:
    """(root, number of links) per text."""
    sets = [shingles(t) for t in texts]
    parent, links = list(range(len(texts))), [0] * len(texts)

    def find(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) / len(x | y) >= threshold:
            links[a] += 1
            links[b] += 1
            i, j = find(a), find(b)
            parent[max(i, j)] = min(i, j)
    return [find(k) for k in range(len(texts))], links


def corpus() -> list[str | None]:
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [list(rng.choice(vocabulary, int(n))) for n in rng.integers(3, 90, 40)]
    texts: list[str | None] = [None, "", "   ", "!!", "one", "one", "One ", "two words"]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(int(rng.integers(0, 6))):
            c = list(b)
            for _ in range(int(rng.integers(0, 4))):
                c[int(rng.integers(0, len(c)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(c))
    return texts


def test_depth_meets_recall():
    depth = near.shortest_depth(0.8, near.TREES, near.FULL_DEPTH, near.RECALL)
    assert 1 - (1 - 0.8**depth) ** near.TREES >= near.RECALL and depth >= 3


def test_prefixes_shorten_until_the_recall():
    shortest = near.shortest_depth(0.8, near.TREES, near.FULL_DEPTH, near.RECALL)
    step = lambda found, depth: near.next_depth(np.array(found, dtype=float), 0.8, near.TREES, depth, shortest, near.RECALL)
    copies, border = [0] * 19 + [10**6], [10**6] + [0] * 19
    assert step([0] * 20, near.FULL_DEPTH) == shortest  # nothing found proves nothing
    assert step(copies, near.FULL_DEPTH) is None  # nearly equal texts meet at the full depth
    assert step(border, near.FULL_DEPTH) == shortest and step(border, shortest) is None
    middle = [0] * 4 + [10**6] + [0] * 15
    assert shortest < step(middle, near.FULL_DEPTH) < near.FULL_DEPTH


def test_near_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, content string, root string")
    roots, links = brute(texts)
    for block in (near.BLOCK, 2):  # blocks of two split every component
        found = {r.doc_id: r for r in near.near_classes(df, block=block).collect()}
        assert [found[k].class_id for k in range(len(texts))] == roots
        assert [found[k].n_links for k in range(len(texts))] == links
    kept = near.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))


def test_near_of_a_group_over_many_blocks(spark):
    """One group of near copies, of which many pairs are near the threshold, against all pairs."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in rng.integers(0, 900, 150)]
    texts = []
    for _ in range(250):
        c = list(base)
        for _ in range(int(rng.integers(0, 4))):
            c[int(rng.integers(0, len(c)))] = f"x{rng.integers(0, 50)}"
        texts.append(" ".join(c))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots, links = brute(texts)
    for block in (near.BLOCK, 40):
        found = {r.doc_id: r for r in near.near_classes(df, block=block).collect()}
        assert [found[k].class_id for k in range(len(texts))] == roots
        assert sum(found[k].n_links for k in range(len(texts))) >= 0.999 * sum(links)
        assert all(found[k].n_links <= links[k] for k in range(len(texts)))


def test_near_awkward_rows(spark):
    schema = "doc_id long, text string, id string, own string, whole long"
    long_text = "some words of text " * 20_000
    texts = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, None), (2, None), (3, long_text), (4, long_text + "end"), (5, " ".join(f"t{k}" for k in range(50_000)))]
    df = spark.createDataFrame([(i, t, "x", "y", 7) for i, t in texts], schema)
    found = sorted(((r.doc_id or -1), r.class_id, r.n_links) for r in near.near_classes(df).select("doc_id", "class_id", "n_links").collect())
    # four shingles against the same and one more: 0.8
    assert found == [(-1, 1, 2), (1, 1, 2), (1, 1, 2), (2, 2, 0), (2, 2, 0), (3, 3, 1), (4, 3, 1), (5, 5, 0)]
    kept = near.keep_one(df)
    assert kept.columns == df.columns and kept.schema == df.schema
    # a null id is the least of its class
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 3, 5]
    assert near.near_classes(df.limit(0)).count() == 0 and near.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (7, None)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent: dict[int, int] = {}

    def find(a: int) -> int:
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if b is not None and a != b:
            i, j = find(a), find(b)
            parent[max(i, j)] = min(i, j)
    assert found == {k: find(k) for k in parent}


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage against a plain version on a small table."""
    words = {"en": "the of and to in is that was for on".split(), "fr": "le la les des est une dans pour qui que".split()}
    rng = np.random.default_rng(6)
    rows = []
    for k in range(120):
        lang = ("en", "fr")[k % 2]
        rows.append((k, " ".join(rng.choice(words[lang], 40)), lang, f"s{k % 3}", 0))
    question = "how many days pass before the 12 trains of Boston reach the end of that line"
    rows += [(500, "123 456 789", "en", "s", 0), (501, None, "en", "s", 0), (502, rows[4][1], "en", "s", 0), (503, f"{rows[6][1]} {question}", "en", "s", 0)]
    rows += [(504, f"{' '.join(rng.choice(words['en'], 40))} token = \"abcdef0123456789\" end", "en", "s", 0)]
    rows = [(a, t, b, c, len(t or "")) for a, t, b, c, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")

    model = language.fit_documents(docs)
    left = [r for r in rows if not model.predict(r[1] or "")[2]]
    assert not {500, 501} & {r[0] for r in left}
    roots, _ = brute([r[1] for r in left])
    left = [left[k] for k in sorted(set(roots))]
    left = [r for r in left if not brute_leaks(r[1], [(1, question)])]
    reference = Tokenizer.from_file(VOCABULARY)
    want = {}
    for doc_id, text, *_ in left:
        spans = brute_spans(text)
        for start, _, end in reversed(spans[:1] if spans else []):
            text = text[:start] + "[SECRET]" + text[end:]
        want[doc_id] = text
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(found) == sorted(want) and 502 not in found and 503 not in found
    for doc_id, text in want.items():
        ids = reference.encode(text, add_special_tokens=False).ids
        assert found[doc_id].decoded == text and np.frombuffer(found[doc_id].ids, "<u4").tolist() == ids and found[doc_id].n_tokens == len(ids)
    assert "[SECRET]" in found[504].decoded


@pytest.mark.parametrize("name", ["op1_chat", "op3_urls", "op5_decontaminate", "op6_licences"])
def test_queries_run_on_the_smallest_tables(spark, name):
    from tidemark.llm import queries

    assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_near_recall_on_the_given_documents(spark):
    """Links of every document whose id is divisible by 50, against all documents, by plain sets."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: shingles(t) for i, t in rows}
    holders: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in near.near_classes(df).collect()}
    links = got = 0
    for i in (i for i in sets if i % 50 == 0):
        common: dict[int, int] = {}
        for x in sets[i]:
            for j in holders[x]:
                common[j] = common.get(j, 0) + 1
        near_ones = [j for j, n in common.items() if j != i and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9]
        links += len(near_ones)
        got += min(found[i].n_links, len(near_ones))
        assert found[i].n_links <= len(near_ones)
        assert sum(found[j].class_id != found[i].class_id for j in near_ones) <= 0.01 * len(near_ones)
    assert links > 50 and got >= 0.999 * links
