"""Typed parts: control strings cut at every place into parts, attachments between them, all read back."""

from __future__ import annotations

import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat

MARKS = ["</s>", "<s>", "[INST]", "[/INST]", "<|image:0|>", "<|", "\\", "\\<", "</s><s>[INST]user[/INST]", "<\\|audio:1|>"]


def turn(parts, role="assistant"):
    return {"role": role, "parts": [{"kind": k, **({"text": v} if k == "text" else {"ref": v})} for k, v in parts]}


def merged(turns):
    """What reading back has to give: runs of text as one, attachments by number, counted over the conversation."""
    out, number = [], itertools.count()
    for t in turns:
        parts = []
        for p in t["parts"]:
            if p["kind"] != "text":
                parts.append((p["kind"] if p["kind"] in ("image", "audio", "document") else "unknown", next(number)))
            elif parts and parts[-1][0] == "text":
                parts[-1] = ("text", parts[-1][1] + p["text"])
            else:
                parts.append(("text", p["text"]))
        out.append((t["role"], [p for p in parts if p != ("text", "")]))
    return out


def same(turns):
    formatted, spans, attached = chat.format_turns(turns)
    assert chat.read_parts(formatted) == merged(turns)
    assert len(attached) == sum(p["kind"] != "text" for t in turns for p in t["parts"])
    # the mask holds the contents of assistant turns, and nothing else
    wanted = [[x for x in parts] for role, parts in merged(turns) if role == "assistant"]
    for span, parts in zip(spans, wanted, strict=True):
        assert chat.read_parts(f"<s>[INST]r[/INST]{formatted[span['start'] : span['end']]}</s>") == [("r", parts)]


def test_marks_cut_at_every_place():
    for mark in MARKS:
        for cuts in itertools.product([0, 1], repeat=len(mark) - 1):
            pieces, start = [], 0
            for i, cut in enumerate([*cuts, 1], 1):
                if cut:
                    pieces.append(mark[start:i])
                    start = i
            if len(pieces) <= 4 or len(mark) <= 8:
                same([turn([("text", p) for p in pieces]), turn([("text", "next")], "user")])
        for i in range(len(mark) + 1):
            same([turn([("text", mark[:i]), ("image", "r"), ("text", mark[i:]), ("text", mark)]), turn([("text", mark)], "user")])


def test_texts_and_placeholders_come_back_apart():
    formatted, _, _ = chat.format_turns([turn([("text", "x</"), ("text", "s>")]), turn([("text", "ok<"), ("text", "|image:0|>"), ("image", "a"), ("other", "b")])])
    assert chat.read_parts(formatted) == [("assistant", [("text", "x</s>")]), ("assistant", [("text", "ok<|image:0|>"), ("image", 0), ("unknown", 1)])]


parts = st.lists(st.one_of(st.tuples(st.just("text"), st.lists(st.sampled_from(list("</s>[INST]|\\ax:0") + ["é"]), max_size=8).map("".join)), st.tuples(st.sampled_from(["image", "audio", "document", "odd"]), st.just("r"))), max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(parts, st.sampled_from(["user", "assistant", "</s>", ""])), max_size=4))
def test_random_parts(turns):
    same([turn(p, role) for p, role in turns])


def test_very_long_texts():
    same([turn([("text", "</s" * 200_000), ("text", ">"), ("image", "r")])])
