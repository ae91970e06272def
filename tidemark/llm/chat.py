"""Chat formatting with typed content parts.

A turn's content is an ordered list of typed parts. A visitor flattens them: text is escaped and
written out, an image, audio clip or document becomes a placeholder whose number counts attachments
from the start of the conversation, and the attachment is recorded with its reference and the tokens
its placeholder will expand to. The template marks each turn as

    ``<s>[INST]`` role ``[/INST]`` content ``</s>``

and no text can contain those marks: inside texts a backslash is doubled, and a backslash is put behind
the first character of ``<s>``, ``</s>``, ``[INST]``, ``[/INST]`` and of ``<|``, which opens placeholders.
Texts that follow each other are one run and are escaped as one, so that no mark comes about where two parts
meet. ``unescape`` undoes exactly that, and ``read_parts`` gives the runs of text and the attachments back. The loss mask is a list of spans of the formatted text, one for the
content of each assistant turn.

Turns of a conversation are ordered by turn (nulls first), then role, then text; repeated rows are
repeated turns. Null roles and texts are empty; rows with a null conversation form one conversation.
Parts of unknown kind are written as attachments of no tokens. Texts of any length are written whole. Empty tables give empty results; other
columns are ignored. A conversation is one row of the result, so its turns meet in one task by nature;
no other rows do.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import by_piece

CONTROL = re.compile(r"\\|<(?=/?s>|\|)|\[(?=/?INST\])")
TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
PLACEHOLDER = re.compile(r"<\|([a-z]+):(\d+)\|>")
LEARNED_ROLE = "assistant"

#: One part of a turn. ``text`` for text; ``ref`` and the sizes for the others.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m.group() == "\\" else m.group() + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


@dataclass
class Flattener:
    """Visits the parts of one conversation in order; one method per kind of part."""

    tile: int = 512
    tokens_per_tile: int = 170
    tokens_per_image: int = 85
    tokens_per_second: float = 12.5
    tokens_per_page: int = 800
    attachments: list[dict] = field(default_factory=list)
    _texts: list[str] = field(default_factory=list)

    def content(self, parts: list[dict]) -> str:
        """All parts of a turn; a run of texts is written where the next attachment, or the end, comes."""
        written = [self.visit(p) for p in parts]
        return "".join([*written, self._run()])

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> str:
        self._texts.append(part.get("text") or "")
        return ""

    def _run(self) -> str:
        run, self._texts = escape("".join(self._texts)), []
        return run

    def visit_image(self, part: dict) -> str:
        across, down = (math.ceil((part.get(k) or 0) / self.tile) for k in ("width", "height"))
        return self._attach("image", part, self.tokens_per_image + self.tokens_per_tile * across * down)

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, math.ceil((part.get("seconds") or 0.0) * self.tokens_per_second))

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, (part.get("pages") or 1) * self.tokens_per_page)

    def visit_unknown(self, part: dict) -> str:
        return self._attach("unknown", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        number = len(self.attachments)
        self.attachments.append({"number": number, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        return f"{self._run()}<|{kind}:{number}|>"


def format_turns(turns: list[dict], **sizes) -> tuple[str, list[dict], list[dict]]:
    """(formatted text, loss spans, attachments) of turns that hold ``role`` and ``parts``."""
    flat = Flattener(**sizes)
    out: list[str] = []
    spans: list[dict] = []
    at = 0
    for turn in turns:
        head = f"<s>[INST]{escape(turn['role'] or '')}[/INST]"
        content = flat.content(turn["parts"] or [])
        out += [head, content, "</s>"]
        at += len(head)
        if turn["role"] == LEARNED_ROLE:
            spans.append({"start": at, "end": at + len(content)})
        at += len(content) + len("</s>")
    return "".join(out), spans, flat.attachments


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, content) of each turn, unescaped; placeholders stay as they are."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def read_parts(formatted: str) -> list[tuple[str, list[tuple[str, str | int]]]]:
    """(role, parts) of each turn: ``("text", run)`` for runs of texts that are not empty, ``(kind, number)`` for attachments."""
    turns = []
    for m in TURN.finditer(formatted):
        parts, at = [], 0
        for hole in PLACEHOLDER.finditer(m[2]):
            parts += [("text", unescape(m[2][at : hole.start()])), (hole[1], int(hole[2]))]
            at = hole.end()
        parts.append(("text", unescape(m[2][at:])))
        turns.append((unescape(m[1]), [p for p in parts if p != ("text", "")]))
    return turns


FORMATTED = (
    "conv_id long, formatted string, loss array<struct<start:int,end:int>>, "
    "attachments array<struct<number:int,kind:string,ref:string,tokens:int>>, expanded_tokens long"
)
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ATTACHED = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))


def as_parts(rows: DataFrame) -> DataFrame:
    """Rows of plain texts as rows of one text part each."""
    given = {"kind": F.lit("text"), "text": F.coalesce("text", F.lit(""))}
    fields = (f.split(":") for f in PART[len("struct<") : -1].split(","))
    part = F.struct(*(given.get(name, F.lit(None).cast(kind)).alias(name) for name, kind in fields))
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_conversations(rows: DataFrame, **sizes) -> DataFrame:
    """One formatted row per conversation of ``rows`` (conv_id, turn, role, parts)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), "parts")
    # what Python holds at once is bounded by the sizes of conversations
    size = F.lit(64) + F.aggregate(F.coalesce("parts", F.array().cast(f"array<{PART}>")), F.lit(0), lambda n, p: n + 64 + F.coalesce(F.length(p["text"]), F.lit(0)))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"), size.cast("long").alias("size"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"), F.sum("size").alias("size"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [format_turns(turns, **sizes) for turns in batch.column("turns").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"), pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], _LOSS),
                pa.array([x[2] for x in done], _ATTACHED), pa.array([sum(a["tokens"] for a in x[2]) for x in done], pa.int64()),
            ],
            ["conv_id", "formatted", "loss", "attachments", "expanded_tokens"],
        )

    return gathered.mapInArrow(by_piece(work, "size"), FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """Read each formatted conversation back and digest its turns and what the loss mask covers."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, loss = batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()
        turns = [read_back(t) for t in texts]
        masked = ["".join(unescape(t[s["start"] : s["end"]]) for s in spans) for t, spans in zip(texts, loss, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"), pa.array(map(len, turns), pa.int64()),
                pa.array([sha("".join(f"{r}\n{t}\n" for r, t in x)) for x in turns], pa.string()),
                pa.array(map(len, masked), pa.int64()), pa.array(map(sha, masked), pa.string()), pa.array(map(len, texts), pa.int64()),
            ],
            DIGESTS.replace(" long", "").replace(" string", "").split(", "),
        )

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(by_piece(work, "formatted"), DIGESTS)


#: A conversation whose texts consist of control strings, in every run of the query.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '(</?s>|\[/?INST\]|<\|)', '\1~', 'g') AS text_escaped,
         regexp_replace(replace(role, '\', '\\'), '(</?s>|\[/?INST\]|<\|)', '\1~', 'g') AS role_escaped FROM t
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role_escaped) + length(text_escaped) + length('<s>[INST][/INST]</s>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
