"""Host-level quality rules: against a plain version, planted hosts, skewed hosts, awkward rows and SQL."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tests.conftest import DATA
from tests.llm.test_text_operators import AWKWARD, LONG, SCHEMA
from tidemark.llm import quality


def counts(text):
    """The six counts of a text, by lists and sets."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    times = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if times[w] > 1 for k in range(3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), dup, len(inside)


def flags(c):
    n, chars, symbols, lines, dup, inside = c
    return {"short": n < 50, "repeats": 100 * inside > 50 * n, "symbols": 10 * symbols > n, "lines": 10 * dup > 3 * lines, "length": chars < 3 * n or chars > 10 * n}


def plain_version(rows):
    """(doc_id, counts, base_failed, host_rules, kept) of (doc_id, text, host), by dictionaries."""
    found = [(i, h, counts(t), flags(counts(t))) for i, t, h in rows]
    hosts = defaultdict(list)
    for _, h, _, f in found:
        if h is not None:
            hosts[h].append(f)
    failed = defaultdict(list)
    for rule, limit in quality.LIMITS.items():
        pairs = [(len(fs), sum(f[rule] for f in fs)) for fs in hosts.values()]
        several = [(n, k) for n, k in pairs if n > 1]
        weight, mean = 4.0, sum(k for _, k in pairs) / max(sum(n for n, _ in pairs), 1)
        if several:
            mean = sum(k / n for n, k in several) / len(several)
            spread = sum(k * (k - 1) / (n * (n - 1)) for n, k in several) / len(several) - mean**2
            weight = min(max(mean * (1 - mean) / spread - 1, 4.0), 1000.0) if spread > 0 else 1000.0
        for h, fs in hosts.items():
            if (sum(f[rule] for f in fs) + weight * mean) / (len(fs) + weight) > limit:
                failed[h].append(rule)
    out = []
    for i, h, c, f in found:
        bad, names = f["short"] or f["repeats"], ",".join(failed[h] if h is not None else [])
        out.append((i, *c, bad, names, not bad and not names))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, *(r[c] for c in quality.COUNTS), r.base_failed, r.host_rules, r.kept) for r in df.collect())


def test_counts():
    rng = np.random.default_rng(5)
    for _ in range(400):
        text = "".join(rng.choice(list("ab #\n\t\v\x0c\r\x1c\x85\xa0é|<日"), int(rng.integers(0, 60))))
        assert quality.measure(text) == counts(text)
    for _ in range(200):
        text = " ".join(rng.choice(["a", "b", "c"], int(rng.integers(0, 25))))
        assert quality.measure(text) == counts(text)
    long = "one two three four five six\n" * 100_000
    assert quality.measure(long) == (600_000, 2_200_000, 0, 100_000, 99_999, 600_000)


def corpus():
    """Clean and bad hosts of many sizes, a host of a third of all rows, hosts of one row, and rows without a host."""
    rng = np.random.default_rng(6)
    clean = lambda: " ".join(f"w{k}x" for k in rng.integers(0, 10_000, 60))
    bad = {"short": lambda: "too short", "symbols": lambda: " ".join(f"#w{k}x" for k in rng.integers(0, 10_000, 60)), "repeats": lambda: "again and again it says " * 15}
    rows = [(clean() if rng.random() > 0.1 else bad["short"](), "hot") for _ in range(500)]
    for kind, make in bad.items():
        rows += [(make() if rng.random() < 0.9 else clean(), f"{kind}.org") for _ in range(40)]
        rows += [(make(), f"one-{kind}.org")]
    rows += [(clean() if rng.random() > 0.05 else bad["repeats"](), f"h{k % 90}.net") for k in range(500)] + [(clean(), None), (bad["symbols"](), None)] * 40
    return [(i, t, h) for i, (t, h) in enumerate(rows)]


@pytest.mark.parametrize("part", [1000, 4])
def test_equals_plain_version(spark, monkeypatch, part):
    """With hosts broadcast where they are large, and with nearly all of them met by the shuffle."""
    monkeypatch.setattr(quality, "PART", part)
    rows = corpus()
    got = quality.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6))
    assert result(got) == plain_version(rows)
    found = {(r.host, r.host_rules) for r in got.collect()}
    assert {h: r for h, r in found if r} == {"short.org": "short", "symbols.org": "symbols", "repeats.org": "repeats"}
    # clean documents of other hosts stay, those of rejected hosts go
    kept = {r.doc_id for r in got.where("kept").collect()}
    assert all((i in kept) == (h not in ("short.org", "symbols.org", "repeats.org") and not (flags(counts(t))["short"] or flags(counts(t))["repeats"])) for i, t, h in rows)


def test_priors(spark):
    """Moments of planted beta rates are found again; equal rates give the greatest weight."""
    rng = np.random.default_rng(7)
    rates, n = rng.beta(2.0, 6.0, 20_000), rng.integers(2, 9, 20_000)
    hosts = spark.createDataFrame([(int(a), int(b)) for a, b in zip(n, rng.binomial(n, rates), strict=True)], "n long, bad long")
    _, priors = quality.fit_priors(hosts, {"bad": ""})
    assert abs(priors["bad"].mean - 0.25) < 0.01 and abs(priors["bad"].weight - 8) < 1
    assert quality.fit_priors(spark.createDataFrame([(10, 5)] * 9, "n long, bad long"), {"bad": ""})[1]["bad"] == (1000.0, 0.5)
    assert quality.fit_priors(hosts.limit(0), {"bad": ""}) == (0, {"bad": (4.0, 0.0)})


def test_awkward_rows_and_empty_table(spark):
    rows = [*AWKWARD, (9, LONG * 3, "en", None, 1, "x")] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(quality.judge_documents(docs)) == plain_version([(r[0], r[1], r[3]) for r in rows])
    assert quality.judge_documents(docs.limit(0)).count() == 0
    # all texts null, all hosts null
    nulls = spark.createDataFrame([(None, None, None)] * 3, "doc_id long, text string, source string")
    assert result(quality.judge_documents(nulls)) == plain_version([(None, None, None)] * 3)


def test_sql(spark, tmp_path):
    rows = spark.createDataFrame(corpus(), "doc_id long, text string, source string").coalesce(1)
    rows.write.parquet(str(tmp_path / "planted"))
    for path in (f"{DATA}/sf0.001/documents.parquet", f"{tmp_path}/planted/*.parquet"):
        con = duckdb.connect()
        con.execute(f"create view documents as from '{path}'")
        names = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rules".split(", ")
        want = Counter(con.execute(f"select {', '.join(names)} from ({quality.oracle()})").fetchall())
        docs = spark.read.parquet(path)
        assert Counter(map(tuple, quality.judge_documents(docs).select(*names).collect())) == want
