"""Toxicity by a classifier chain.

The categories are predicted one after another; each linear model sees the words of the text, the
beginnings of its words (inflected forms share them) and the probabilities of all earlier categories.
While training, those probabilities come from models that have not seen the row (out-of-fold); the models
used for prediction are then fitted on all rows. Every model chooses its own terms, from the rows it is
fitted on, and the threshold comes from out-of-fold scores.

Only the last category, ``toxic``, has given labels. The earlier ones are learnt targets: the toxic rows,
parted into ``KINDS`` groups by the terms that make them toxic (spherical k-means). No list of words is used.

Null and empty texts hold no words: they get the probabilities of an empty text and are never toxic.
Texts of any length are read whole. Repeated rows give repeated results; an empty table gives none;
without labels of both kinds nothing is toxic. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import by_piece, texts_of
from tidemark.llm.hashing import WORD, word_hashes
from tidemark.llm.sample import bounded_sample

#: Groups of toxic rows that are categories of their own, before ``toxic`` itself.
KINDS = 2
CATEGORIES = (*(f"kind_{k + 1}" for k in range(KINDS)), "toxic")
STEMS = (3, 4, 5, 6, 7)
LEAST_PROBABILITY = 0.2


def words_in(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def terms(words: set[str]) -> set[str]:
    """The words, and their beginnings of several lengths, marked as such."""
    found = set(words)
    for n in STEMS:
        found.update({f"{w[:n]}*" for w in words if len(w) > n})
    return found


@dataclass(frozen=True)
class Chain:
    """Place of each term, and for each category a weight per term, per earlier category, and a bias."""

    terms: dict[str, int]
    weights: tuple[np.ndarray, ...]
    threshold: float

    def predict(self, words: set[str]) -> np.ndarray:
        if not self.terms:
            return np.zeros(len(CATEGORIES))
        at = [self.terms[t] for t in terms(words) & self.terms.keys()]
        out: list[float] = []
        n = len(self.weights[0]) - 1
        for w in self.weights:
            z = w[at].sum() + float(np.dot(w[n:-1], out)) + w[-1]
            out.append(1 / (1 + np.exp(-z)))
        return np.array(out)


def _fit(rows: np.ndarray, cols: np.ndarray, n: int, width: int, earlier: np.ndarray, y: np.ndarray, steps: int = 200) -> np.ndarray:
    """L2-regularised logistic regression by accelerated full gradients; ``rows``/``cols`` are set cells."""
    w = np.zeros(width + earlier.shape[1] + 1)
    look, k = w.copy(), 1.0
    ridge = 1e-4

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=v[cols], minlength=n) + earlier @ v[width:-1] + v[-1]

    def back(e: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(cols, weights=e[rows], minlength=width), e @ earlier, [e.sum()]))

    # the loss curves by at most a quarter of the largest eigenvalue of the second moments
    v = np.ones(len(w))
    for _ in range(20):
        v = back(times(v)) / n
        top = float(np.linalg.norm(v))
        v /= top
    rate = 1 / (top * 1.05 / 4 + ridge)
    for _ in range(steps):
        gradient = back(1 / (1 + np.exp(-np.clip(times(look), -40, 40))) - y) / n
        gradient[:-1] += ridge * look[:-1]
        new, nk = look - rate * gradient, (1 + np.sqrt(1 + 4 * k * k)) / 2
        look, w, k = new + (k - 1) / nk * (new - w), new, nk
    return w


def _score(w: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int, width: int, earlier: np.ndarray) -> np.ndarray:
    z = np.bincount(rows, weights=w[cols], minlength=n) + earlier @ w[width:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class _Cells:
    """Which row holds which term, as two aligned arrays."""

    def __init__(self, texts: list[str]):
        hashed = [word_hashes(sorted(terms(words_in(t)))) for t in texts]
        self.n = len(texts)
        self.rows = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in hashed])
        self.vocabulary, cols = np.unique(np.concatenate(hashed), return_inverse=True)
        self.cols = cols.astype(np.int32)

    def strongest(self, y: np.ndarray, inside: np.ndarray, width: int) -> np.ndarray:
        """The terms that stand in the rows of ``y`` more than by chance, by their z score over the rows ``inside``."""
        use = inside[self.rows]
        seen = np.bincount(self.cols[use], minlength=len(self.vocabulary))
        hits = np.bincount(self.cols[use], weights=y[self.rows[use]], minlength=len(self.vocabulary))
        share = y[inside].mean()
        z = (hits - seen * share) / np.sqrt(seen * share * (1 - share) + 1) * (seen > 2)
        return np.sort(np.argsort(-z, kind="stable")[:width])

    def of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and places among ``chosen`` of the cells that hold a chosen term."""
        place = np.full(len(self.vocabulary), -1)
        place[chosen] = np.arange(len(chosen))
        cell = place[self.cols] >= 0
        return self.rows[cell], place[self.cols[cell]]

    def fit(self, y: np.ndarray, inside: np.ndarray, earlier: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a model fitted on the rows ``inside``, and its weights."""
        chosen = self.strongest(y, inside, width)
        rows, cols = self.of(chosen)
        use = inside[rows]
        renumbered = np.cumsum(inside) - 1
        return chosen, _fit(renumbered[rows[use]], cols[use], int(inside.sum()), len(chosen), earlier[inside], y[inside])

    def score(self, chosen: np.ndarray, w: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return _score(w, *self.of(chosen), self.n, len(chosen), earlier)


def kinds_of(cells: _Cells, toxic: np.ndarray, kinds: int, width: int, rounds: int = 20) -> list[np.ndarray]:
    """The toxic rows in groups: k-means of their unit vectors of strongest terms, from rows far apart."""
    bad = np.flatnonzero(toxic > 0)
    rows, cols = cells.of(cells.strongest(toxic, np.ones(cells.n, dtype=bool), width))
    use = toxic[rows] > 0
    x = np.zeros((len(bad), width))
    x[np.searchsorted(bad, rows[use]), cols[use]] = 1
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1)
    centres = [x[int(x.sum(axis=1).argmax())]]
    for _ in range(kinds - 1):
        centres.append(x[int(np.max([x @ c for c in centres], axis=0).argmin())])
    for _ in range(rounds):
        group = np.argmax(x @ np.array(centres).T, axis=1)
        centres = [(m / max(np.linalg.norm(m), 1e-12)) if (m := x[group == k].sum(axis=0)).any() else centres[k] for k in range(kinds)]
    out = []
    for k in range(kinds):
        y = np.zeros(cells.n)
        y[bad[group == k]] = 1
        out.append(y)
    return out


def train(texts: list[str], toxic: np.ndarray, width: int = 512, folds: int = 5) -> Chain:
    """A chain from the words of each row (as one string) and their labels.

    Terms are held as hashes; their strings are made again, row by row, where they are needed.
    """
    toxic = np.asarray(toxic, dtype=np.float64)
    n, bad = len(texts), toxic.sum()
    if not bad or bad == n:
        return Chain({}, (), 2.0)
    cells = _Cells(texts)
    # each label is dealt evenly to the folds
    fold = np.where(toxic > 0, np.cumsum(toxic > 0), np.cumsum(toxic <= 0)) % folds
    every = np.ones(n, dtype=bool)
    earlier = np.empty((n, 0))
    models = []
    for y in [*kinds_of(cells, toxic, KINDS, min(width, len(cells.vocabulary))), toxic]:
        models.append(cells.fit(y, every, earlier, width))
        out_of_fold = np.zeros(n)
        for f in range(folds):
            outside = fold == f
            if outside.any() and not outside.all():
                out_of_fold[outside] = cells.score(*cells.fit(y, ~outside, earlier, width), earlier)[outside]
        earlier = np.column_stack((earlier, out_of_fold))
    # the last column holds out-of-fold probabilities of the labels themselves: choose the best F1
    p = earlier[:, -1]
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(toxic[order])
    f1 = 2 * right / (np.arange(1, n + 1) + bad)
    best = int(np.argmax(f1))
    below = p[order][best + 1] if best + 1 < n else 0.0
    # one table of terms for all models: a term that a model has not chosen weighs nothing there
    used = np.unique(np.concatenate([chosen for chosen, _ in models]))
    weights = []
    for chosen, w in models:
        spread = np.zeros(len(used) + len(w) - len(chosen))
        spread[np.searchsorted(used, chosen)] = w[: len(chosen)]
        spread[len(used) :] = w[len(chosen) :]
        weights.append(spread)
    wanted = dict(zip(cells.vocabulary[used].tolist(), range(len(used)), strict=True))
    named: dict[str, int] = {}
    for text in texts:
        found = list(terms(words_in(text)))
        named.update((t, k) for t, h in zip(found, word_hashes(found).tolist(), strict=True) if (k := wanted.get(h)) is not None)
    # with few rows the best cut can fall among clean rows: it is never below the least probability
    return Chain(named, tuple(weights), float(max((p[order][best] + below) / 2, LEAST_PROBABILITY)))


def fit_documents(docs: DataFrame, labels: DataFrame, rows: int = 6000) -> Chain:
    """Fit on about ``rows`` labelled documents, never over twice as many (a documented bound)."""
    given = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = {r.doc_id: r.toxic for r in bounded_sample(given, rows, "toxicity")}
    # the chosen ids and flags are bounded by ``rows``: small by construction
    ids = docs.sparkSession.createDataFrame(sorted(chosen.items()), "doc_id long, toxic long")
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id")
    # of several texts under one id the least, so that the model does not depend on the order of rows
    joined = joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [" ".join(sorted(words_in(t))) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column("toxic"), batch.column("doc_id")], ["words", "toxic", "doc_id"])

    sample = joined.mapInArrow(by_piece(work, "text"), "words string, toxic long, doc_id long").collect()
    sample = sorted(sample, key=lambda r: (r.doc_id, r.words))
    return train([r.words for r in sample], np.array([r.toxic > 0 for r in sample], dtype=bool))


SCHEMA = "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean"


def score_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    """Probabilities of every category and the decision, for each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        found = [words_in(t) for t in texts_of(batch)]
        p = np.array([model.predict(x) for x in found]).reshape(-1, len(CATEGORIES))
        verdict = (p[:, -1] >= model.threshold) & np.array([len(x) > 0 for x in found], dtype=bool)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(CATEGORIES))), pa.array(verdict)],
            ["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"],
        )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(by_piece(work, "text"), SCHEMA)
