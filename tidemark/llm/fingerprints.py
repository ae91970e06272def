"""Document fingerprints by consistent weighted sampling.

A text is the multiset of its lower-cased words. For each of ``samples`` positions a word of weight w
draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its own hash, takes t = floor(ln w / r + b) and competes
with ln c - r (t - b) - r; the least wins, and (word, t) is the sample. Two texts agree at a position
with the probability of their generalised Jaccard similarity (sum of minima over sum of maxima).

Null is the empty text. A text without words has an empty fingerprint, alike (1.0) to empty ones only.
Texts of any length are read whole. Rows with equal ids follow each other by text; with one row, that
row is its own next. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import pieces
from tidemark.llm.hashing import STEP, mix, seeds, word_hashes, words_of

SAMPLES = 64
_FLUSH_CHARS = 1 << 20
_FLUSH_ROWS = 4096
#: Bins of ids for each run that they are put together to.
FINE = 8
_FIRST = -(1 << 63)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def sample_texts(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """One row of 16-bit samples per text; -1 everywhere for a text without words."""
    words, counts = words_of(texts)
    out = np.full((len(texts), samples), -1, dtype=np.int32)
    if not words:
        return out
    owner = np.repeat(np.arange(len(texts)), counts)
    vocabulary, term = np.unique(word_hashes(words), return_inverse=True)
    key, weight = np.unique(owner * len(vocabulary) + term, return_counts=True)
    owner, term = np.divmod(key, len(vocabulary))
    # what a term draws depends on its hash and weight only: draw once for each such pair
    top = int(weight.max()) + 1
    pair, place = np.unique(term * top + weight, return_inverse=True)
    h, log_weight = vocabulary[pair // top], np.log(pair % top)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    filled = owner[first]
    lengths = np.diff(np.append(first, len(owner)))
    with np.errstate(over="ignore"):
        for k, seed in enumerate(seeds(samples, 9)):
            base = mix(h + seed)
            u = [_uniform(mix(base + np.uint64(j) * STEP)) for j in range(1, 6)]
            r = -np.log(u[0] * u[1])
            log_c = np.log(-np.log(u[2] * u[3]))
            t = np.floor(log_weight / r + u[4])
            race = (log_c - r * (t - u[4]) - r)[place]
            best = np.minimum.reduceat(race, first)
            winners = np.flatnonzero(race == np.repeat(best, lengths))
            winners = winners[np.searchsorted(winners, first)]
            chosen = place[winners]
            out[filled, k] = (mix(h[chosen] ^ mix(t[chosen].astype(np.int64).astype(np.uint64) + seed)) >> np.uint64(48)).astype(np.int32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of agreeing positions, row by row: the estimate of generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def text_of(row: np.ndarray) -> str:
    return "" if row[0] < 0 else row.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _result(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Rows of (id, text, next text), each but the last followed by the row after it or a new run."""
    texts = [t for _, t, _ in rows]
    changed = [edited(t, n) for _, t, n in rows]
    # the next text is most often the next row's own: only others are sampled apart
    extra = [i for i, (_, _, n) in enumerate(rows) if i + 1 == len(rows) or rows[i + 1][1] != n]
    found = sample_texts([*texts, *changed, *(rows[i][2] for i in extra)])
    own, after = found[: len(rows)], found[len(rows) : 2 * len(rows)]
    following = np.roll(own, -1, axis=0)
    following[extra] = found[2 * len(rows) :]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _, _ in rows], pa.int64()), pa.array(map(len, texts), pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            pa.array(map(text_of, own), pa.string()), pa.array(map(text_of, after), pa.string()),
            pa.array(likeness(own, after)), pa.array(likeness(own, following)),
        ],
        [x.split()[0] for x in SCHEMA.split(", ")],
    )


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a run with the row after it; the next run's first row stands at the run's end.

    What is held between two results is bounded by characters and by rows.
    """
    held: list[tuple[int | None, str, str]] = []
    size = 0
    waiting: tuple[int | None, str] | None = None  # the row whose next one has not come yet
    for piece in (p for batch in batches for p in pieces(batch, "text", limit=_FLUSH_CHARS, rows=_FLUSH_ROWS)):
        for guest, doc_id, text in zip(*(piece.column(c).to_pylist() for c in ("guest", "doc_id", "text")), strict=True):
            if waiting is not None:
                held.append((*waiting, text))
                size += 2 * len(waiting[1])
                waiting = None
            if not guest:
                waiting = (doc_id, text)
            if size > _FLUSH_CHARS or len(held) >= _FLUSH_ROWS:
                yield _result(held)
                held, size = [], 0
    if waiting is not None:
        held.append((*waiting, waiting[1]))
    if held:
        yield _result(held)


def _constant(values: list, kind: str) -> Column:
    """A nested list as one constant: a column per number would make plans as long as the list."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def place_among(bounds: list[int], key: Column) -> Column:
    """How many of the ascending ``bounds`` lie below ``key``, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds) - 1) + 1
    chunks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda some, k: F.array_size(F.filter(some, lambda b: b < k))
    whole = below(_constant([c[-1] for c in chunks], "array<bigint>"), key)
    inside = F.get(_constant(chunks, "array<array<bigint>>"), whole)
    return whole * width + F.coalesce(below(inside, key), F.lit(0))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit, and how alike they are.

    Ids are cut into as many runs of about equal size as the session has shuffle partitions, out of ``FINE``
    times as many bins (their bounds, first ids and sizes, three numbers per bin, are all the driver sees). Texts
    move once, run k to partition k; the first row of each run also goes to the end of the run before it, so that
    every row finds its next one beside it.
    """
    runs = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bins = FINE * runs
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))
    cuts = sorted(set(docs.select(F.percentile_approx(key, [i / bins for i in range(1, bins)], 10 * bins).alias("q")).first().q or []))
    sizes = docs.select(key.alias("k"), place_among(cuts, key).alias("bin"), (F.coalesce(F.length("text"), F.lit(0)) + 64).alias("size"))
    found = sorted((r.bin, r.k, r.size) for r in sizes.groupBy("bin").agg(F.min("k").alias("k"), F.sum("size").alias("size")).collect())
    # a run ends with the bin that fills its part of the whole
    whole, upto, bounds, starts = sum(size for *_, size in found), 0, [], []
    for i, (at, first, size) in enumerate(found):
        if not i or upto * runs // whole != (upto - found[i - 1][2]) * runs // whole:
            bounds += [cuts[found[i - 1][0]]] if i else []
            starts.append(first)
        upto += size
    own = place_among(bounds, key)
    # the first id of a run is a guest of the run before, that of the first run one of the last
    before = [(i - 1) % len(starts) for i in range(len(starts))]
    at = place_among(starts, key)
    other = F.when(F.get(_constant(starts, "array<bigint>"), at) == key, F.get(_constant(before, "array<int>"), at))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), key.alias("k"), own.alias("own"), other.alias("other"))
    places = F.when(F.col("other").isNull(), F.array("own")).otherwise(F.array("own", "other"))
    placed = rows.select("doc_id", "text", "k", F.posexplode(places).alias("guest", "run")).withColumn("guest", F.col("guest") > 0)
    return placed.repartitionById(runs, "run").sortWithinPartitions("run", "guest", "k", "text").mapInArrow(_pairs, SCHEMA)
