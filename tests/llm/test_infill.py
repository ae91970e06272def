"""Fill-in-the-middle: against a plain version that cuts lists of units, awkward rows, and round trips."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_text_operators import AWKWARD, SCHEMA
from tidemark.llm import infill


def plain_version(text: str | None, doc_id: int | None, seed: int = 1):
    """(n, form, prefix_chars, middle_chars, output) by lists of units."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def same(text: str, doc_id: int) -> None:
    got = infill.transform(text, doc_id)
    assert (got.n, got.form, got.prefix_chars, got.middle_chars, got.output) == plain_version(text, doc_id)
    assert infill.restore(got.output, got.form) == text


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab Z9[`{@é日\n<PSM>\x00Ł", max_size=40), st.integers(0, 10**12))
def test_equals_lists_of_units(text, doc_id):
    same(text, doc_id)


def test_every_cut_of_every_run():
    for text in ("", "a", "1", "ab12cd", "12ab", "  a  b", "é<P", "<S<M"):
        runs = infill.encode_runs(text)
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
        assert runs.n_units == len(units)
        for u in range(len(units) + 1):
            assert infill.place(runs, u) == len("".join(units[:u]))


def test_whole_very_long_texts():
    rng = random.Random(3)
    long = "".join(rng.choice(["word", " ", "9", "é", "\n"]) for _ in range(1_000_000))
    for k in range(6):
        same(long, k)


@pytest.mark.parametrize("digests", [False, True])
def test_documents(spark, digests):
    docs = spark.createDataFrame([*AWKWARD, (7, "holds <M> itself", "en", "s", 3, "x")] * 2, SCHEMA)
    rows = infill.infill_documents(docs, digests=digests).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for doc_id, text, *_ in [*AWKWARD, (7, "holds <M> itself")] * 2:
        n, form, prefix, middle, output = plain_version(text, doc_id)
        want.append((doc_id, n, form, prefix, middle, sha(output), sha(text or "")) if digests else (doc_id, output, form, n, prefix, middle))
    assert Counter(map(tuple, rows)) == Counter(want)
    assert {r.form for r in rows if r.doc_id in (1, 2, 7)} == {"plain"}
    assert infill.infill_documents(docs.limit(0), digests=digests).count() == 0


def test_rates_and_marks():
    forms = Counter(infill.transform("some text of words", k).form for k in range(20_000))
    assert abs(forms["plain"] / 20_000 - 0.1) < 0.01 and abs(forms["spm"] / 20_000 - 0.18) < 0.01
    always = [infill.transform("a <P> b", k, rate=100, suffix_first=100, marks=("[p]", "[s]", "[m]")) for k in range(50)]
    assert {r.form for r in always} == {"spm"}
    assert {infill.restore(r.output, r.form, ("[p]", "[s]", "[m]")) for r in always} == {"a <P> b"}
