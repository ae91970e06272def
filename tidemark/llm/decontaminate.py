"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of slots and words: a number becomes ``<num>``, a unit behind a number
``<unit>``, a capitalised word inside a sentence ``<name>``, everything else its lower-cased word; a run
of slots of one kind is one slot (``Maria Lopez``, ``12 000``).
Windows of ``width`` consecutive template tokens are hashed and joined with the windows of the
benchmark. Where windows agree, the item is aligned with the document around them: runs of at least ``RUN`` equal
tokens on diagonals (place in the document less place in the item) near to the windows' are chained in the
order of both texts, over words that one side has more, and the slots under a chain must be consistent:
equal item values stand opposite equal document values and the other way round. A chain counts as a leak
when its tokens cover ``coverage`` of the item. Windows are half as long as an item with fewer than twice
``width`` tokens, so that one edit leaves one whole; items shorter than ``width`` are one window by
themselves.

Both sides stay distributed. The documents' windows pass a Bloom filter of the benchmark's, whose bits are
bounded by ``FILTER_BITS``: what it lets through by mistake is dropped by the join. Only documents with a
window that passes move, one of each text, with their places; the join by hash gives pairs of a text and an
item, and these are aligned. The leaking texts meet the documents again by their SHA-256.

Windows made of slots alone match nothing. Null, empty and short texts have no windows and are clean.
Texts of any length are read whole. Repeated documents are judged alike, row by row; items with equal
templates and values count as one with the smallest id; different texts under one id are all searched. An
item without id is searched too: it counts as one more item, but ``items`` lists ids only. Empty tables on
either side give rows without items, or none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import by_piece, texts_of
from tidemark.llm.hashing import STEP, mix, seeds, word_hashes
from tidemark.llm.storage import cut

#: Words that are units when they follow a number.
UNITS = frozenset(
    "kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches meter meters metre metres l ml liter liters litre litres "
    "hour hours hr hrs minute minutes min second seconds sec day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent mph kmh degrees".split()
)
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]|[%$€£°]")
WIDTH = 8
#: Tokens of the shortest run a chain takes in.
RUN = 4
COVERAGE = 0.7
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
SLOTS = frozenset((NUM, NAME, UNIT))
_MARKS = frozenset(".!?\n")
_SYMBOLS = frozenset("%$€£°")
#: The filter has about 256 bits a window, but never more than these: 16 MB, whatever the benchmark.
FILTER_BITS = 1 << 27
#: Up to so many leaking texts (32 bytes each) are broadcast; beyond, rows meet them by a shuffle.
BROADCAST_TEXTS = 200_000


def canonical(text: str) -> tuple[list[str], list[str]]:
    """Template tokens, and the original value of each."""
    template: list[str] = []
    values: list[str] = []
    start, last_number = True, False
    for raw in TOKEN.findall(text):
        if raw in _MARKS:
            start = True
            continue
        low = raw.lower()
        if raw[0].isdigit():
            token, last_number = NUM, True
        else:
            if (last_number and low in UNITS) or raw in _SYMBOLS:
                token = UNIT
            elif not start and raw != low:
                token = NAME
            else:
                token = low
            last_number = False
        if token in SLOTS and not start and template and template[-1] == token:
            values[-1] += " " + low
        else:
            template.append(token)
            values.append(low)
        start = False
    return template, values


#: What a raw token is, in the low bits of its hash: a mark, number, unit symbol or word; capitalised; a unit's name.
_MARK, _NUMBER, _SYMBOL, _WORD, _CAPITAL, _UNIT_WORD, _BITS = 0, 1, 2, 3, 4, 8, 15
_CACHE_TOKENS = 100_000


class _Tokens(dict):
    """raw token -> hash of its lower case with what it is; emptied when it holds too many."""

    def __missing__(self, raw: str) -> int:
        if len(self) >= _CACHE_TOKENS:
            self.clear()
        low = raw.lower()
        if raw in _MARKS or raw in _SYMBOLS:
            kind = _MARK if raw in _MARKS else _SYMBOL
        elif raw[0].isdigit():
            kind = _NUMBER
        else:
            kind = _WORD | (_CAPITAL if raw != low else 0) | (_UNIT_WORD if low in UNITS else 0)
        value = self[raw] = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")) & ~_BITS | kind
        return value


_tokens = _Tokens()


def _forget_tokens() -> None:
    _tokens.clear()


def template_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the template tokens of all texts, whether each is a slot, and their number per text.

    The same templates as ``canonical``'s, for many texts at once and without the values.
    """
    raw: list[str] = []
    counts = np.empty(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        found = TOKEN.findall(text)
        counts[i] = len(found)
        raw += found
    value = np.fromiter(map(_tokens.__getitem__, raw), dtype=np.uint64, count=len(raw))
    owner = np.repeat(np.arange(len(texts)), counts)
    what = (value & np.uint64(_BITS)).astype(np.int8)
    place = np.flatnonzero(what != _MARK)
    value, what, owner = value[place], what[place], owner[place]
    first = np.diff(owner, prepend=-1) != 0
    start = first | (np.diff(place, prepend=-1) != 1)
    after = lambda x: np.concatenate((x[:1], x[:-1]))
    kind = what & 3
    unit = (kind == _SYMBOL) | ((what & _UNIT_WORD > 0) & (after(kind) == _NUMBER) & ~first)
    slot = np.where(kind == _NUMBER, 1, np.where(unit, 2, np.where((what & _CAPITAL > 0) & ~start, 3, 0)))
    kept = ~((slot > 0) & ~start & (slot == after(slot)))
    hashes = np.where(slot > 0, _SLOT_HASHES[slot], value & ~np.uint64(_BITS))
    return hashes[kept], slot[kept] > 0, np.bincount(owner[kept], minlength=len(texts))


_SLOT_HASHES = np.concatenate((np.zeros(1, np.uint64), word_hashes([NUM, UNIT, NAME])))


def window_hashes(tokens: np.ndarray, counts: np.ndarray, widths: list[int]):
    """For each width: the width, where each text's windows start among ``tokens``, and their hashes."""
    position = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts) - position
    factors = seeds(max(widths, default=0), 5) | np.uint64(1)
    rolled = np.zeros(len(tokens), dtype=np.uint64)
    for j in range(max(widths, default=0)):
        rolled[: max(len(tokens) - j, 0)] += tokens[j:] * factors[j]
        if j + 1 in widths:
            at = np.flatnonzero(left > j)
            yield j + 1, at, mix(rolled[at] + np.uint64(j + 1) * STEP)


def filter_places(hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The ``k``-th place of each hash in a filter of ``bits`` (a power of two)."""
    return (hashes + np.uint64(k) * (hashes >> np.uint64(32) | np.uint64(1))) & np.uint64(bits - 1)


def item_width(size: int, width: int) -> int:
    """The length of the windows of an item of ``size`` tokens."""
    return min(width, size // 2) if size >= width else size


def consistent(item: list[str], doc: list[str]) -> bool:
    """Whether the two lists of slot values stand in one-to-one correspondence."""
    pairs = set(zip(item, doc, strict=True))
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def short_names(template: list[str], values: list[str]) -> list[str]:
    """``values``, with a name of several words as the name by which the text shortens it, where it does."""
    names = {v for t, v in zip(template, values, strict=True) if t == NAME}
    out = list(values)
    for i, (t, v) in enumerate(zip(template, values, strict=True)):
        if t == NAME and " " in v:
            words = v.split()
            own = [w for k in range(1, len(words)) for w in (" ".join(words[:k]), " ".join(words[k:])) if w in names]
            out[i] = own[0] if own else v
    return out


def leak_share(item: tuple[list[str], list[str]], doc: tuple[list[str], list[str]], hits: list[tuple[int, int]], width: int = WIDTH, coverage: float = COVERAGE) -> float:
    """The largest share of the item under one consistent chain; ``hits`` are places (document, item) where windows agree.

    ``item`` and ``doc`` are templates with their values, as ``canonical`` gives them.
    """
    own, item_values = item[0], short_names(*item)
    template, values = doc
    size, w = len(own), item_width(len(own), width)
    diagonals = sorted({at - place for at, place in hits if own[place : place + w] == template[at : at + w]})
    best = 0.0
    # windows whose diagonals are within the item's length of each other may share a chain
    start = 0
    for k in range(1, len(diagonals) + 1):
        if k < len(diagonals) and diagonals[k] - diagonals[k - 1] <= size:
            continue
        found = equal_runs(own, template, diagonals[start:k], width)
        start = k
        if found:
            low = min(p + d for p, _, d in found)
            high = max(end + d for _, end, d in found)
            region = short_names(template[low:high], values[low:high])
            best = max(best, chain(found, own, item_values, region, low, coverage) / size)
    return best


def equal_runs(own: list[str], template: list[str], group: list[int], width: int) -> list[tuple[int, int, int]]:
    """(begin, end, diagonal) of the item's runs that the document holds on diagonals near ``group``."""
    size = len(own)
    near = sorted({d + k for d in group for k in range(-width, width + 1)})
    least = min(RUN, size)
    out = []
    for d in near:
        p, end = max(0, -d), min(size, len(template) - d)
        while p < end:
            if own[p] != template[p + d]:
                p += 1
                continue
            q = p + 1
            while q < end and own[q] == template[q + d]:
                q += 1
            if q - p >= least and any(t not in SLOTS for t in own[p:q]):
                out.append((p, q, d))
            p = q
    return out


def chain(
    runs: list[tuple[int, int, int]], own: list[str], item: list[str], doc: list[str], low: int, coverage: float = COVERAGE
) -> int:
    """Most tokens under a chain of ``runs``, in order in both texts, whose slots are consistent.

    Every run keeps its chains by what their slots stand opposite to; of chains that agree in that, the
    longest. ``doc`` holds the document's values from ``low`` on. Two runs of a chain are at most the
    item's length apart in the document.
    """
    # where no chain can cover enough even without regard to slots, none is worth its states
    covered = {p for begin, end, _ in runs for p in range(begin, end)}
    if len(covered) < coverage * len(own):
        return 0
    runs = sorted(runs, key=lambda r: (r[0] + r[2], r[0]))
    slots = [p for p, t in enumerate(own) if t in SLOTS]
    states: list[dict[frozenset, int]] = []
    best = 0
    for i, (begin, end, d) in enumerate(runs):
        kept: dict[frozenset, int] = {}
        options: list[tuple[int, frozenset, int]] = [(begin, frozenset(), 0)]
        for j in range(i - 1, -1, -1):
            b, e, c = runs[j]
            if begin + d - (b + c) > 2 * len(own):
                break
            if begin + d - (e + c) > len(own):
                continue
            # what overlaps counts for the run before
            first = max(begin, e, e + c - d)
            if first >= end:
                continue
            options += [(first, pairs, n) for pairs, n in states[j].items()]
        for first, before, n in options:
            pairs = before | {(item[p], doc[p + d - low]) for p in slots if first <= p < end}
            if consistent([x for x, _ in pairs], [y for _, y in pairs]):
                kept[pairs] = max(kept.get(pairs, 0), n + end - first)
        states.append(kept)
        best = max([best, *kept.values()])
    return best


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, item_text): one row for each template with its values."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = []
        for text in texts_of(batch):
            template, values = canonical(text)
            keys.append(xxhash.xxh128_digest("\0".join((*template, "", *values)).encode("utf-8", "surrogatepass")) if template else None)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("item_id"), batch.column("text")], ["item", "item_id", "item_text"])

    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    keyed = rows.mapInArrow(by_piece(work, "text", done=_forget_tokens), "item binary, item_id long, item_text string").where("item is not null")
    return cut(keyed.groupBy("item").agg(F.min("item_id").alias("item_id"), F.min("item_text").alias("item_text")), narrow=True)


def _windows(items: DataFrame, width: int) -> DataFrame:
    """(hash, item, place): the windows of the benchmark that are not made of slots alone, and their width ``w``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, slot, counts = template_hashes(texts_of(batch, "item_text"))
        owner = np.repeat(np.arange(len(counts)), counts)
        wanted = np.array([item_width(n, width) for n in counts.tolist()], dtype=np.int64)[owner]
        starts = (np.cumsum(counts) - counts)[owner]
        plain = np.concatenate(([0], np.cumsum(~slot)))
        parts: list[tuple] = []
        for w, at, hashes in window_hashes(tokens, counts, list(range(1, width + 1))):
            use = (wanted[at] == w) & (plain[at + w] > plain[at])
            at = at[use]
            parts.append((np.full(len(at), w), hashes[use].view(np.int64), owner[at], at - starts[at]))
        w, h, o, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(w, pa.int32()), pa.array(h, pa.int64()), batch.column("item").take(pa.array(o)), pa.array(p, pa.int32())], ["w", "hash", "item", "place"]
        )

    return cut(items.mapInArrow(by_piece(work, "item_text", done=_forget_tokens), "w int, hash long, item binary, place int"))


def _filter(windows: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the windows, as words of 64 bits: at most ``FILTER_BITS``, whatever their number ``n``."""
    bits = min(FILTER_BITS, 1 << max(16, (256 * n - 1).bit_length()))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
        at = np.unique(np.concatenate([filter_places(hashes, bits, k) for k in range(3)]))
        words = (at >> np.uint64(6)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])

    set_bits = windows.select("hash").mapInArrow(by_piece(work), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, dtype=np.uint64)
    out[set_bits.column("word").to_numpy()] = set_bits.column("bits").to_numpy().view(np.uint64)
    return out


def _content() -> F.Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("content")


def _passing(docs: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """(content, text, hash, at): the texts with windows that pass the filter, and those windows."""
    widths = sorted(r.w for r in windows.select("w").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(_filter(windows, n))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = shared.value
        bits = len(words) << 6
        tokens, _, counts = template_hashes(texts_of(batch))
        owner, starts = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
        found = [(np.empty(0, np.int64), np.empty(0, np.uint64))]
        for _, at, hashes in window_hashes(tokens, counts, widths):
            for k in range(3):
                place = filter_places(hashes, bits, k)
                ok = (words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)) > 0
                at, hashes = at[ok], hashes[ok]
            found.append((at, hashes))
        at, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        at, hashes = at[order], hashes[order]
        texts, number = np.unique(owner[at], return_counts=True)
        ends = pa.array(np.concatenate(([0], np.cumsum(number))), pa.int32())
        own = at - starts[owner[at]]
        rows = pa.array(texts, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("content").take(rows), batch.column("text").take(rows),
                pa.ListArray.from_arrays(ends, pa.array(hashes.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(own, pa.int32())),
            ],
            ["content", "text", "hash", "at"],
        )

    passed = docs.select(_content(), "text").mapInArrow(by_piece(work, "text", limit=1 << 20, done=_forget_tokens), "content binary, text string, hash array<long>, at array<int>")
    return cut(passed.groupBy("content").agg(*(F.first(c).alias(c) for c in ("text", "hash", "at"))))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """(content, items, n_items, coverage) of each text of ``docs`` that leaks an item."""
    items = _items(benchmark)
    windows = _windows(items, width)
    passed = _passing(docs, windows, windows.count())
    hits = passed.select("content", F.explode(F.arrays_zip("hash", "at")).alias("hit")).select("content", "hit.*")
    hits = hits.join(windows.select("hash", "item", "place"), "hash")
    pairs = cut(hits.groupBy("content", "item").agg(F.collect_list(F.struct("at", "place")).alias("hits")), narrow=True)
    both = pairs.join(items, "item").join(passed.select("content", "text"), "content")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        contents, shares = batch.column("content").to_pylist(), []
        last: tuple = (None, None)
        for content, text, item, hit in zip(contents, texts_of(batch), texts_of(batch, "item_text"), batch.column("hits").to_pylist(), strict=True):
            if content != last[0]:  # the pairs of a text stand together
                last = (content, canonical(text))
            shares.append(leak_share(canonical(item), last[1], [(h["at"], h["place"]) for h in hit], width, coverage))
        keep = [i for i, x in enumerate(shares) if x >= coverage]
        rows = pa.array(keep, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("content").take(rows), batch.column("item_id").take(rows), pa.array([shares[i] for i in keep], pa.float64())], ["content", "item_id", "share"]
        )

    found = both.select("content", "text", "item_id", "item_text", "hits").mapInArrow(by_piece(work, "text", done=_forget_tokens), "content binary, item_id long, share double")
    ids = F.array_sort(F.collect_set("item_id"))
    nameless = F.max(F.col("item_id").isNull().cast("long"))
    return cut(found.groupBy("content").agg(ids.alias("items"), (F.size(ids) + nameless).alias("n_items"), F.max("share").alias("coverage")), narrow=True)


def _beside(texts: DataFrame) -> DataFrame:
    """``texts``, to be broadcast where their number allows it."""
    return F.broadcast(texts) if texts.count() <= BROADCAST_TEXTS else texts


def judge_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row: whether it leaks items, which, and the largest covered share."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = leaks(rows, benchmark, **options)
    joined = rows.select("doc_id", _content()).join(_beside(found.select("content", "n_items", "items", "coverage")), "content", "left")
    return joined.select(
        "doc_id", F.col("n_items").isNotNull().alias("leaked"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item."""
    found = leaks(docs.select("text"), benchmark, **options)
    # a row travels as one value, so that its columns may have any names
    rows = docs.select(_content(), F.struct(*docs.columns).alias("whole"))
    return rows.join(_beside(found.select("content")), "content", "left_anti").select("whole.*")
