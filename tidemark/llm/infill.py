"""Fill-in-the-middle transformation over run-length encoded character classes.

A text is cut into units: a run of letters ``[A-Za-z]+`` is one unit, any other code point is one too. It is
held as its maximal runs of letters and of others, each with its first code point and the number of units
before it. A cut behind ``u`` units is found by binary search for the run that holds it, and its place in the
text by arithmetic: in a run of others, every unit is one code point; a run of letters is entered at its
beginning only.

The draws of a document come from the SHA-256 of ``<seed>:<doc_id>``. The parts are joined behind marks,
prefix first (``psm``) or suffix first (``spm``); a text that is empty, holds a mark or is not drawn stays as it
is (``plain``). ``restore`` takes the parts apart again.

Null texts are empty, hence plain with no units. A null id is drawn like the empty string. Texts of any length
are read whole, in pieces of bounded size where they are shorter. Repeated rows give repeated results, an empty
table an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.batches import by_piece, texts_of

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 documents, so many are transformed, and of those so many with the suffix first.
RATE = 90
SUFFIX_FIRST = 20
SEED = 1


class Runs(NamedTuple):
    """Maximal runs of one class: first code point, units before the run, whether it is of letters."""

    start: np.ndarray
    units: np.ndarray
    letters: np.ndarray
    n_chars: int
    n_units: int


def encode_runs(text: str) -> Runs:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = ((points | 32) >= 97) & ((points | 32) <= 122) & (points < 128)
    start = np.flatnonzero(np.diff(letter, prepend=~letter[:1]))
    kinds = letter[start]
    sizes = np.where(kinds, 1, np.diff(start, append=len(points)))
    ends = np.cumsum(sizes)
    return Runs(start, ends - sizes, kinds, len(points), int(ends[-1]) if len(ends) else 0)


def place(runs: Runs, cut: int) -> int:
    """How many code points lie before the cut behind ``cut`` units."""
    if cut >= runs.n_units:
        return runs.n_chars
    i = int(np.searchsorted(runs.units, cut, side="right")) - 1
    inside = 0 if runs.letters[i] else cut - int(runs.units[i])
    return int(runs.start[i]) + inside


class Infilled(NamedTuple):
    output: str
    form: str
    n: int
    prefix_chars: int | None
    middle_chars: int | None


def transform(text: str, doc_id: int | None, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> Infilled:
    """One text as prefix, middle and suffix in the order drawn for its id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    runs = encode_runs(text)
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return Infilled(text, "plain", runs.n_units, None, None)
    a, b = (place(runs, cut) for cut in sorted(x % (runs.n_units + 1) for x in h[:2]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return Infilled(f"{marks[1]}{suffix}{marks[0]}{prefix}{marks[2]}{middle}", "spm", runs.n_units, a, b - a)
    return Infilled(f"{marks[0]}{prefix}{marks[1]}{suffix}{marks[2]}{middle}", "psm", runs.n_units, a, b - a)


def restore(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text that ``output`` was made of; no part holds a mark, so the first of each kind is the real one."""
    if form == "plain":
        return output
    second = marks[1] if form == "psm" else marks[0]
    start = len(marks[0] if form == "psm" else marks[1])
    between = output.index(second, start)
    last = output.index(marks[2], between)
    first_part, second_part, middle = output[start:between], output[between + len(second) : last], output[last + len(marks[2]) :]
    return first_part + middle + second_part if form == "psm" else second_part + middle + first_part


SCHEMA = "doc_id long, output string, form string, n long, prefix_chars long, middle_chars long"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def infill_documents(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS, digests: bool = False
) -> DataFrame:
    """(doc_id, output, form, n, prefix_chars, middle_chars) of every row; one pass, nothing moves.

    With ``digests``, hashes of the output and of the text restored from it stand in place of the output.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_pylist()
        rows = [transform(t, i, seed, rate, suffix_first, marks) for t, i in zip(texts_of(batch), ids, strict=True)]
        counts = [pa.array([getattr(r, k) for r in rows], pa.int64()) for k in ("n", "prefix_chars", "middle_chars")]
        form = pa.array([r.form for r in rows], pa.string())
        if digests:
            made = pa.array([_sha256(r.output) for r in rows], pa.string())
            back = pa.array([_sha256(restore(r.output, r.form, marks)) for r in rows], pa.string())
            columns = [batch.column("doc_id"), counts[0], form, *counts[1:], made, back]
        else:
            columns = [batch.column("doc_id"), pa.array([r.output for r in rows], pa.string()), form, *counts]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    schema = DIGESTS if digests else SCHEMA
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(by_piece(work, "text"), schema)


ORACLE_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, len(units) AS n,
    ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2,
    ('0x' || h[17:24])::BIGINT % 100 AS c3, ('0x' || h[25:32])::BIGINT % 100 AS c4,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c3 >= 90 THEN 'plain'
      WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:least(c1, c2)], '') AS prefix,
    array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
    array_to_string(units[greatest(c1, c2) + 1:n], '') AS suffix
  FROM cut
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
