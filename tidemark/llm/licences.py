"""Licence scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser
evaluates the expressions behind the tags.

Texts are lower-cased (A-Z only) and cut into words of ``[0-9a-z]`` and everything beyond ASCII. The
words, joined by single spaces, run once through one automaton of all phrases and of the identifier
tag ``spdx license identifier``. Where the automaton finds the tag, the original line behind it is parsed as an
expression of identifiers, ``AND``, ``OR`` (a slash as well), ``WITH`` and parentheses, in one pass.

Null texts are empty: no words, no places, empty labels, score 0. Texts of any length are read whole.
Repeated rows give repeated results, an empty table none; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.batches import by_piece, texts_of

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Phrase (words by single spaces) -> label; the base.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Names and opening words of licences in common use, as their texts write them.
NOTICES = {
    "academic free license": "afl",
    "affero general public license": "agpl",
    "all rights reserved": "proprietary",
    "artistic license": "artistic",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "business source license": "busl",
    "cc0 1 0 universal": "cc0",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "eclipse public license": "epl",
    "elastic license": "elastic",
    "european union public licence": "eupl",
    "free and unencumbered software released into the public domain": "unlicense",
    "free documentation license": "gfdl",
    "ibm public license": "ipl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "microsoft public license": "ms-pl",
    "mozilla public license": "mpl",
    "mulan permissive software license": "mulanpsl",
    "open database license": "odbl",
    "open font license": "ofl",
    "open software license": "osl",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "postgresql license": "postgresql",
    "python software foundation license": "python",
    "redistribution and use in source and binary forms": "bsd",
    "server side public license": "sspl",
    "universal permissive license": "upl",
    "w3c software notice and license": "w3c",
    "zlib license": "zlib",
    "zope public license": "zpl",
}
TAG = "spdx license identifier"
#: What may stand between the tag and its expression.
LEAD = re.compile(r"[ \t]*[:=]?[ \t]*")
#: Openness of a label, 0 to 1: what the score of a document is made of. Its keys are the families of identifiers.
OPENNESS = {
    "0bsd": 1.0, "afl": 0.9, "agpl": 0.1, "apache": 1.0, "apsl": 0.6, "artistic": 0.8, "blueoak": 1.0, "bsd": 1.0, "bsl": 1.0, "busl": 0.05,
    "cc-by": 0.9, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "cc-by-sa": 0.4, "cc0": 1.0, "cddl": 0.6, "cecill": 0.3, "cpl": 0.6, "curl": 1.0, "ecl": 1.0,
    "elastic": 0.05, "epl": 0.6, "eupl": 0.4, "fsfap": 1.0, "gfdl": 0.3, "gpl": 0.3, "ipl": 0.6, "isc": 1.0, "lgpl": 0.5, "lppl": 0.6,
    "mit": 1.0, "mpl": 0.6, "ms-pl": 0.8, "ms-rl": 0.6, "mulanpsl": 1.0, "ncsa": 1.0, "odbl": 0.4, "odc-by": 0.9, "ofl": 0.7, "openssl": 0.9,
    "osl": 0.3, "php": 0.9, "postgresql": 1.0, "proprietary": 0.0, "python": 1.0, "ruby": 0.9, "sleepycat": 0.3, "sspl": 0.05, "unlicense": 1.0, "upl": 1.0,
    "vim": 0.8, "w3c": 0.9, "wtfpl": 1.0, "x11": 1.0, "zlib": 1.0, "zpl": 0.9,
}
LONGEST = max(map(len, [*OPENNESS, "unlicensed"]))
#: Exceptions behind ``WITH`` that let code be linked or generated without the licence's own terms.
LINKING = ("autoconf-exception", "bison-exception", "bootloader-exception", "classpath-exception", "ecos-exception", "font-exception",
           "gcc-exception", "linux-syscall-note", "llvm-exception", "ocaml-lgpl-linking-exception", "qt-lgpl-exception", "wxwindows-exception")
#: The label of an identifier of no known family.
OTHER = "other"
TOKEN = re.compile(r"[()/]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: Binding strength of the operators, the tightest last.
BINDING = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """The label of an identifier, by its longest known beginning: ``Apache-2.0`` -> ``apache``."""
    low = identifier[: LONGEST + 1].lower()
    for n in range(min(len(low), LONGEST), 0, -1):
        if low[:n] in OPENNESS and low[n : n + 1] in ("", "-", ".", "+"):
            return low[:n]
    return "proprietary" if low in ("none", "unlicensed") else OTHER


def parse(expression: str) -> list[str] | None:
    """The longest leading part of ``expression`` that is an expression, in postfix; else None.

    Shunting-yard: operands go out, operators wait on a stack until a looser one comes. What is out stays out, so the
    longest part is remembered as its length and the few operators that waited then, one of each strength at most.
    """
    out: list[str] = []
    stack: list[str] = []
    best: tuple[int, list[str]] | None = None
    operand_next, depth = True, 0
    for match in TOKEN.finditer(expression):
        token = match.group()
        low = "or" if token == "/" else token.lower()
        if token == "(":
            if not operand_next:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if operand_next or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif low in BINDING:
            if operand_next:
                break
            while stack and stack[-1] != "(" and BINDING[stack[-1]] >= BINDING[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        else:
            if not operand_next:
                break
            out.append(token)
            operand_next = False
        if not operand_next and not depth:
            best = len(out), stack[::-1]
    return out[: best[0]] + best[1] if best else None


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels of an expression and its openness: ``or`` offers the better, ``and`` binds to the worse.

    An exception behind ``with`` has no label; one that permits linking takes half of what a licence lacks.
    """
    stack: list[tuple[set[str], float, str]] = []
    for token in postfix:
        if token not in BINDING:
            label = family(token)
            stack.append(({label}, OPENNESS.get(label, 0.5), token.lower()))
            continue
        (right, r, name), (left, v, _) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, (v + 1) / 2 if name.startswith(LINKING) else v, ""))
        else:
            stack.append((left | right, max(v, r) if token == "or" else min(v, r), ""))
    return stack[0][:2]


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    original = text.encode("utf-8", "surrogatepass")
    data = original.lower()
    words = WORDS.findall(data)
    joined = b" " + b" ".join(words) + b" " if words else b""
    # one letter per byte, so that places in it are places in the bytes
    ends = [(end, phrase) for end, phrase in automaton().iter(joined.decode("latin-1"))]
    base, labels, scores = [], set(), []
    if ends:
        spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        for end, phrase in ends:
            if phrase in BASE:
                base.append((int(np.searchsorted(spaces, end)) - phrase.count(" ") - 1, BASE[phrase]))
                labels.add(BASE[phrase])
            elif phrase in NOTICES:
                labels.add(NOTICES[phrase])
        scores = [OPENNESS[x] for x in labels]
        if any(phrase == TAG for _, phrase in ends):
            after = [m.end() for m in WORDS.finditer(data)]
            for end, phrase in ends:
                if phrase != TAG:
                    continue
                # the place of the tag's last word in the text, and the rest of its line
                start = after[int(np.searchsorted(spaces, end)) - 1]
                line = re.compile(rb"[^\r\n]*").match(original, start).group().decode("utf-8", "surrogatepass")
                if postfix := parse(line[LEAD.match(line).end() :]):
                    found, score = evaluate(postfix)
                    labels |= found
                    scores.append(score)
    places = [p for p, _ in base]
    return (
        len(words), len(base), min(places, default=None), max(places, default=None),
        ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), min(scores, default=0.0),
    )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double"
)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Licence findings per row. ``score`` is the openness (0 to 1) of the strictest finding, else 0."""
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(t) for t in texts_of(batch)]
        found = [batch.column("doc_id"), *([r[k] for r in rows] for k in range(7))]
        return pa.RecordBatch.from_arrays([pa.array(x, t) if isinstance(x, list) else x for x, t in zip(found, types, strict=True)], names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(by_piece(work, "text"), SCHEMA)
