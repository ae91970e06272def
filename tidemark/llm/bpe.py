"""Byte-level BPE by a contiguous rank array.

A word is held as the row of its parts and, beside it, the ranks of all adjacent pairs. The smallest
rank is found by scanning, its boundary deleted, and the two neighbouring ranks looked up again,
until no adjacent pair has a rank. Words of equal length are scanned together as the rows of one
matrix; words over ``SHORT`` bytes, where scanning would be quadratic, take a heap over the same ranks.

Nulls are empty texts. Empty texts have no ids. Texts of any length are encoded whole; they are cut
into words only where the pre-tokenizer's pattern cuts them. Repeated rows and ids are kept row by
row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.batches import by_piece, texts_of

#: Fixed value: the pre-tokenizer pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 40
_NONE = np.int32(1 << 30)
_CACHE_WORDS = 200_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files -> that byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            letters[chr(256 + len(letters) - len(plain))] = b
    return letters


@cache
def latin_pattern() -> re.Pattern:
    """``PATTERN`` over the code points under 256, where the standard library's matcher is the faster one."""

    def ranges(kind: str) -> str:
        points = np.array([ord(c) for c in regex.findall(kind, "".join(map(chr, range(256))))])
        cuts = np.flatnonzero(np.diff(points) > 1)
        first, last = points[[0, *(cuts + 1)]], points[[*cuts, -1]]
        return "".join(f"\\x{a:02x}-\\x{b:02x}" for a, b in zip(first, last, strict=True))

    letter, number, space = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    written = {
        r"[^\s\p{L}\p{N}]": f"[^{space}{letter}{number}]",
        r"\p{L}": f"[{letter}]",
        r"\p{N}": f"[{number}]",
        r"\S": f"[^{space}]",
        r"\s": f"[{space}]",
    }
    return re.compile(re.sub("|".join(map(re.escape, written)), lambda m: written[m.group()], PATTERN))


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, definition: str):
        data = json.loads(definition)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = {raw(t): i for t, i in data["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.array([vocab[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        left, right = ([vocab[raw(p[k])] for p in pairs] for k in (0, 1))
        merged = [vocab[raw(a) + raw(b)] for a, b in pairs]
        self.size = size
        keys = np.array(left, dtype=np.int64) * size + np.array(right, dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = order.astype(np.int32)
        self.merged = np.array(merged, dtype=np.int32)
        self.pair_rank = dict(zip(keys.tolist(), range(len(pairs)), strict=True))
        self.first = self.rank(*np.meshgrid(self.byte_ids, self.byte_ids, indexing="ij"))
        self.pattern = regex.compile(PATTERN)
        self.splitter = (
            regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))
            if self.special
            else None
        )
        self.cache: dict[str, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each adjacent pair, ``_NONE`` where the vocabulary has no such merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode_equal(self, words: list[bytes]) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of words of one length."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)
        parts = self.byte_ids[raw]
        out: list[bytes] = [b""] * len(words)
        rows = np.arange(len(words))
        ranks = self.first[raw[:, :-1], raw[:, 1:]]
        length = np.full(len(words), parts.shape[1])
        while len(rows):
            if parts.shape[1] > 1:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), at]
            else:
                best = np.full(len(rows), _NONE)
            done = best == _NONE
            if done.any():
                ids = parts[done].astype("<u4")
                step, flat = 4 * ids.shape[1], ids.tobytes()
                for k, (row, n) in enumerate(zip(rows[done].tolist(), length[done].tolist(), strict=True)):
                    out[row] = flat[k * step : k * step + 4 * n]
                left = ~done
                rows, parts, ranks, length = rows[left], parts[left], ranks[left], length[left]
                if not len(rows):
                    break
                at, best = at[left], best[left]
            index = np.arange(len(rows))
            parts[index, at] = self.merged[best]
            # delete the boundary: everything right of it moves one place to the left
            column = np.arange(parts.shape[1] - 1)
            parts = parts[index[:, None], column + (column > at[:, None])]
            length -= 1
            if parts.shape[1] > 1:
                column = column[:-1]
                ranks = ranks[index[:, None], column + (column >= at[:, None])]
                for side in (at - 1, at):
                    ok = np.flatnonzero((side >= 0) & (side < length - 1))
                    p = side[ok]
                    ranks[ok, p] = self.rank(parts[ok, p], parts[ok, p + 1])
                for_end = np.flatnonzero(at > length - 2)
                ranks[for_end[:, None], column[None, :]] = np.where(
                    column[None, :] >= (length[for_end] - 1)[:, None], _NONE, ranks[for_end]
                )
        return out

    def encode_long(self, word: bytes) -> bytes:
        """The same merges in the same order by a heap: smallest rank first, then leftmost."""
        part = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(part)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        get, size = self.pair_rank.get, self.size
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := get(part[i] * size + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (q := get(part[k] * size + part[after[k]])) is not None:
                    heapq.heappush(heap, (q, k, part[k], part[after[k]]))
        return np.array([p for p in part if p >= 0], dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode words that the cache lacks, all words of one length at a time."""
        wanted = set(words)
        missing = list(wanted.difference(self.cache))
        if len(self.cache) + len(missing) > _CACHE_WORDS:
            self.cache.clear()
            missing = list(wanted)
        if not missing:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in missing]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        order = np.argsort(lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(order)], strict=True):
            index = order[a:b].tolist()
            if len(raw[index[0]]) > SHORT:
                self.cache.update((missing[i], self.encode_long(raw[i])) for i in index)
                continue
            for k in range(0, len(index), 20_000):
                some = index[k : k + 20_000]
                self.cache.update(zip([missing[i] for i in some], self.encode_equal([raw[i] for i in some]), strict=True))

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(text)
        return latin_pattern().findall(text)

    def segments(self, text: str) -> list[tuple[str, int]]:
        """Ordinary stretches (id -1) and special tokens (their id), in order."""
        if self.splitter is None or not any(t in text for t in self.special):
            return [(text, -1)]
        out, at = [], 0
        for m in self.splitter.finditer(text):
            out += [(text[at : m.start()], -1), (m.group(), self.special[m.group()])]
            at = m.end()
        return [*out, (text[at:], -1)]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        cut = [[(self.words(s) if i < 0 else None, i) for s, i in self.segments(t)] for t in texts]
        self.learn(list(chain.from_iterable(words for t in cut for words, _ in t if words)))
        get = self.cache.__getitem__
        return [
            np.frombuffer(
                b"".join(b"".join(map(get, words)) if i < 0 else int(i).to_bytes(4, "little") for words, i in t),
                dtype="<u4",
            )
            for t in cut
        ]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def encode_documents(docs: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """Ids (little-endian unsigned 32-bit) and decoded text of each document's whole text.

    ``vocabulary`` is the path of a tokenizers JSON file, read by the driver and broadcast: its size is
    that of the vocabulary, whatever the documents. With ``digests`` the SHA-256 of ids and decoded
    text are returned in place of them, so that no text leaves the workers.
    """
    with open(vocabulary, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(_Definition(f.read()))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = definition.value.codec()
        ids = codec.encode_batch(texts_of(batch))
        decoded = map(codec.decode, ids)
        raw = [x.tobytes() for x in ids]
        if digests:
            first = [hashlib.sha256(x).hexdigest() for x in raw]
            second = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        else:
            first, second = pa.array(raw, pa.binary()), list(decoded)
            names = ["doc_id", "n_tokens", "ids", "decoded"]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(first), pa.array(second)], names
        )

    def forget() -> None:
        definition.value.codec().cache.clear()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else SCHEMA
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(by_piece(work, "text", done=forget), schema)


class _Definition:
    """A vocabulary as text; each worker builds its codec once."""

    def __init__(self, text: str):
        self.text = text
        self._codec: Codec | None = None

    def __getstate__(self):
        return {"text": self.text, "_codec": None}

    def codec(self) -> Codec:
        if self._codec is None:
            self._codec = Codec(self.text)
        return self._codec
