"""Stable 64-bit hashes of words and shingles, vectorised over many texts at once."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
#: Odd 64-bit multipliers of the splitmix64 finaliser and the golden ratio step.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
_CACHE_WORDS = 100_000


class _WordHashes(dict):
    """word -> xxhash64; emptied when it holds too many words, so its memory is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _WordHashes()


def forget_words() -> None:
    """Empties the cache of this worker."""
    _hashes.clear()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * STEP + np.uint64(salt))


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Lower-cased words of all texts in one list, and each text's number of words."""
    found: list[str] = []
    counts = np.empty(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = WORD.findall(text.lower())
        counts[i] = len(words)
        found += words
    return found, counts


def windows(values: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` consecutive values of a text, and the number of windows per text.

    A text shorter than ``width`` but not empty has one window, made of all it has.
    """
    n = len(values)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.empty(0, np.int64)
    factors = seeds(width, width) | np.uint64(1)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        if n > j:
            rolled[: n - j] += values[j:] * factors[j]
    per_text = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    keep = np.zeros(n, dtype=bool)
    if n:
        position = np.arange(n) - np.repeat(starts, counts)
        keep = position < np.repeat(per_text, counts)
        for i in np.flatnonzero((counts > 0) & (counts < width)):
            a, k = int(starts[i]), int(counts[i])
            rolled[a] = np.sum(values[a : a + k] * factors[:k], dtype=np.uint64) ^ STEP
    return mix(rolled[keep]), per_text


def unique_per_text(values: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` with repeats inside a text removed, sorted in each text; new numbers per text."""
    owner = np.repeat(np.arange(len(per_text)), per_text)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    first = np.ones(len(v), dtype=bool)
    first[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[first], np.bincount(o[first], minlength=len(per_text)).astype(np.int64)
