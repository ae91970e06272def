"""Licence expressions: time in proportion to their length, slashes, and tags found where the automaton says."""

from __future__ import annotations

import time

from tidemark.llm import licences


def test_very_long_expressions_take_linear_time():
    for text in (" OR ".join(["MIT", "(GPL-3.0 WITH Classpath-exception-2.0 AND Apache-2.0)", "x" * 50] * 30_000), "(" * 400_000 + "MIT" + ")" * 400_000, "MIT AND " * 400_000, "a" * 3_000_000):
        began = time.perf_counter()
        postfix = licences.parse(text)
        licences.evaluate(postfix)
        assert time.perf_counter() - began < 4, text[:30]
    assert licences.parse("MIT AND " * 3) == ["MIT", "MIT", "and", "MIT", "and"]


def test_time_grows_with_the_length():
    def taken(n):
        text = "SPDX-License-Identifier: " + " OR ".join(f"MIT-{k}" for k in range(n))
        began = time.perf_counter()
        licences.scan(text)
        return time.perf_counter() - began

    small = max(taken(20_000), 0.02)
    assert taken(80_000) < 12 * small


def test_slashes_are_or():
    assert licences.parse("MIT/Apache-2.0") == ["MIT", "Apache-2.0", "or"]
    assert licences.parse("MIT / GPL-2.0 AND BSD-3-Clause") == ["MIT", "GPL-2.0", "BSD-3-Clause", "and", "or"]
    assert licences.parse("/MIT") is None and licences.parse("MIT/") == ["MIT"]
    assert licences.scan("// SPDX-License-Identifier: GPL-3.0/MIT")[5:] == ("gpl,mit", 1.0)


def test_places_of_tags():
    one = licences.scan("é SPDX-License-Identifier: MIT\nword (spdx license identifier = ISC) and SPDX License Identifier\tZlib OR zpl")
    assert one[5] == "isc,mit,zlib,zpl"
    assert licences.scan("SPDX-License-Identifier:\nMIT")[5] == "" and licences.scan("spdx license identifier")[5] == ""
    assert licences.scan("spdx license identifierMIT")[5] == "" and licences.scan("spdx license identifier 日本 MIT")[5] == "mit"


def test_families_are_not_kept():
    assert not hasattr(licences.family, "cache_info") and licences.family("Apache-2.0") == "apache" and licences.family("x" * 100_000) == licences.OTHER
