"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its subwords: character n-grams of 1 to 3 code points in
its lower-cased words, with word boundaries as characters, hashed into a fixed number of rows. Rows and
softmax are trained together by stochastic gradient descent in numpy on a bounded sample; temperature
and rejection thresholds are calibrated on a part of that sample that training does not see.

A softmax is sure of anything that lies on one side of its borders, so a second score falls off away from
the training data: the share of a text's trigrams that are familiar in some learned language, as an upper
bound that allows for short texts. Texts that mix learned languages are familiar throughout and stay. Its
threshold parts held-out texts from negatives made of them: the same texts judged without their own
language, and with their letters shuffled.

Null and empty texts, and texts without any letter, are ``und`` with score 0 and are rejected. Texts of
any length are read whole. Rows are judged one by one: repeated rows, an empty table and further
columns change nothing; a table without any label gives ``und`` everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import by_piece, texts_of
from tidemark.llm.hashing import seeds
from tidemark.llm.sample import bounded_sample_of_each

UNDETERMINED = "und"
_POINTS = 0x110000
#: Bits of a trigram's hash in the table of familiar trigrams.
_TRIGRAM_BITS = 18
#: A trigram is familiar from this share of a language's texts on; standard errors a short text is allowed.
_FAMILIAR, _ERRORS = 0.02, 1.64


def _classes() -> np.ndarray:
    """Per code point: 0 for none-letters, else the lower-case letter."""
    table = np.zeros(_POINTS, dtype=np.uint32)
    for c in range(_POINTS):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            table[c] = ord(low) if len(low := x.lower()) == 1 else c
    return table


_table: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """Code points, letters lower-cased and everything else 0, with a 0 at both ends."""
    global _table
    if _table is None:
        _table = _classes()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros(len(points) + 2, dtype=np.uint32)
    out[1:-1] = _table[points]
    return out


def subwords(text: str) -> tuple[np.ndarray, int]:
    """Hashes of all subwords of ``text``, with repeats, and how many at their end are trigrams."""
    x = letters(text)
    if not x.any():
        return np.empty(0, dtype=np.uint64), 0
    x = x.astype(np.uint64)
    a, b, c = seeds(3, 8) | np.uint64(1)
    one, two = x * a, x[:-1] * b + x[1:] * a
    three = two[:-1] * c + x[2:] * b
    letter = x > 0
    found = [one[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]]
    return np.concatenate(found) * (b ^ c), len(found[2])


def buckets(hashes: np.ndarray, rows: int) -> np.ndarray:
    """Rows of hashed subwords; ``rows`` is a power of two."""
    return (hashes >> np.uint64(64 - rows.bit_length() + 1)).astype(np.int64)


def familiarity(share: float, n: int) -> float:
    """Upper bound (Wilson's) of the familiar share of ``n`` trigrams; 0 where none is familiar."""
    z = _ERRORS * _ERRORS
    if not n or not share:
        return 0.0
    return (share + z / (2 * n) + _ERRORS * (share * (1 - share) / n + z / (4 * n * n)) ** 0.5) / (1 + z / n)


@dataclass(frozen=True)
class Model:
    """Embeddings folded into the softmax: one row of class scores per bucket."""

    languages: tuple[str, ...]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    #: Whether texts of some language commonly hold a trigram; and the least familiarity of a text.
    familiar: np.ndarray
    least: float

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether it is rejected."""
        hashes, n = subwords(text) if self.languages else ((), 0)
        if not len(hashes):
            return UNDETERMINED, 0.0, True
        found = buckets(hashes, len(self.scores))
        counts = np.bincount(found, minlength=len(self.scores))
        logits = (counts @ self.scores / len(found) + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = int(p.argmax())
        share = self.familiar[buckets(hashes[-n:], len(self.familiar))].mean()
        rejected = p[best] < self.threshold or familiarity(float(share), n) < self.least
        return self.languages[best], float(p[best]), bool(rejected)


def trigram_shares(trigrams: list[np.ndarray], langs: list[int], n_langs: int) -> np.ndarray:
    """Whether each trigram is familiar in each language: in ``_FAMILIAR`` of its texts, and in two if it has 20."""
    held = np.zeros((n_langs, 1 << _TRIGRAM_BITS), dtype=np.int32)
    for x, y in zip(trigrams, langs, strict=True):
        held[y, np.unique(x)] += 1
    texts = np.bincount(np.array(langs, dtype=np.int64), minlength=n_langs)
    return held >= np.maximum(np.ceil(texts * _FAMILIAR), np.where(texts < 20, 1, 2))[:, None]


def least_familiarity(good: np.ndarray, bad: np.ndarray, share: float = 0.001) -> float:
    """A threshold between bad texts (all but 5 %) and good ones (all but ``share``), nearer to the bad.

    Where the two overlap, the bad texts' bound, but at most what all but five times ``share`` of the good have.
    """
    if not len(good) or not len(bad):
        return 0.0
    low, high = float(np.quantile(bad, 0.95)), float(np.quantile(good, share))
    return low + (high - low) / 4 if low < high else min(low, float(np.quantile(good, 5 * share)))


def shuffled(text: str, rng: np.random.Generator) -> str:
    """``text`` with its letters dealt anew to their places."""
    points = np.array(list(text))
    at = np.flatnonzero([c.isalpha() for c in text])
    points[at] = points[rng.permutation(at)]
    return "".join(points)


def train(
    texts: list[str], langs: list[str], rows: int = 1 << 13, width: int = 16, epochs: int = 12,
    rate: float = 2.0, seed: int = 8, rejected_share: float = 0.001,
) -> Model:
    """Stochastic gradient descent on embeddings and softmax; every sixth text calibrates."""
    languages = tuple(sorted(set(langs)))
    if not languages:
        return Model((), np.zeros((rows, 0)), np.zeros(0), 1.0, 1.0, np.zeros(1 << _TRIGRAM_BITS, bool), 0.0)
    counted, trigrams, kept = [], [], []
    for text, lang in zip(texts, langs, strict=True):
        hashes, last = subwords(text)
        if len(hashes):
            at, n = np.unique(buckets(hashes, rows), return_counts=True)
            trigrams.append(buckets(hashes[-last:], 1 << _TRIGRAM_BITS).astype(np.int32))
            kept.append(text)
            counted.append((at, (n / n.sum()).astype(np.float32), languages.index(lang)))
    rng = np.random.default_rng(seed)
    held = counted[::6] if len(counted) >= 60 else counted
    fit = [x for i, x in enumerate(counted) if i % 6] if len(counted) >= 60 else counted
    embedding = rng.normal(0, 0.1, (rows, width)).astype(np.float32)
    weight = rng.normal(0, 0.1, (width, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(fit)):
            at, share, y = fit[i]
            hidden = share @ embedding[at]
            z = hidden @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = weight @ p
            weight -= step * 0.1 * np.outer(hidden, p)
            bias -= step * 0.01 * p
            embedding[at] -= step * np.outer(share * 50, back)
    scores = (embedding @ weight).astype(np.float64)
    logits = np.array([share @ scores[at] + bias for at, share, _ in held])
    truth = np.array([y for *_, y in held], dtype=np.int64)

    def confidence(t: float) -> np.ndarray:
        e = np.exp((logits - logits.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.01, 20, 80)
    # held-out rows without an error do not prove more than (n + 1) / (n + 2), so the temperature stays bounded
    doubt = 1 / (len(truth) + 2)
    target = np.full((len(truth), len(languages)), doubt / max(len(languages) - 1, 1))
    target[np.arange(len(truth)), truth] = 1 - doubt
    losses = [-(target * np.log(np.maximum(confidence(t), 1e-12))).sum(axis=1).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    # a right answer may be rejected in rejected_share of cases; two languages that share a text are no doubt
    best = confidence(temperature)
    right = np.sort(best.max(axis=1)[best.argmax(axis=1) == truth])
    threshold = float(min(right[int(rejected_share * len(right))] * 0.9 if len(right) else 1.0, 0.5, 1.5 / len(languages)))
    # familiar trigrams of the fitted part, judged on the held-out one and on negatives made of it
    chosen = [i % 6 == 0 for i in range(len(counted))] if len(counted) >= 60 else [True] * len(counted)
    part = [i for i in range(len(counted)) if len(counted) < 60 or i % 6]
    familiar = trigram_shares([trigrams[i] for i in part], [counted[i][2] for i in part], len(languages))
    good, bad = [], []
    some = familiar.any(axis=0)
    others = [np.delete(familiar, y, axis=0).any(axis=0) for y in range(len(languages))]
    for i in np.flatnonzero(chosen).tolist():
        n = len(trigrams[i])
        good.append(familiarity(float(some[trigrams[i]].mean()), n))
        if len(languages) > 1:
            bad.append(familiarity(float(others[counted[i][2]][trigrams[i]].mean()), n))
        hashes, n = subwords(shuffled(kept[i], rng))
        if n:
            bad.append(familiarity(float(some[buckets(hashes[-n:], len(some))].mean()), n))
    least = least_familiarity(np.array(good), np.array(bad), rejected_share)
    return Model(languages, scores, bias.astype(np.float64), temperature, threshold, some, least)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that no model may learn from: crc32 of the id, as text, is a multiple of five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit_documents(docs: DataFrame, per_language: int = 400, languages: int = 6) -> Model:
    """Train on about ``per_language`` labelled documents of each language (all, where it has fewer).

    A language with more than its part of ``per_language * languages`` rows of the whole table gives that
    part. Never over twice as many (a documented bound).
    """
    fit = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sample = sorted((r.text, r.lang) for r in bounded_sample_of_each(fit, "lang", per_language, per_language * languages, "language", also=("text",)))
    return train([t for t, _ in sample], [lang for _, lang in sample])


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def identify_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Prediction, calibrated probability and rejection for each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_()),
            ],
            ["doc_id", "held_out", "lang_pred", "score", "rejected"],
        )

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(by_piece(work, "text"), SCHEMA)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose language the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([not shared.value.predict(t)[2] for t in texts_of(batch)], pa.bool_()))

    return docs.mapInArrow(by_piece(work, "text", limit=1 << 19), docs.schema)
