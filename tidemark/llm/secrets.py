"""Secret scans over an incremental ledger of blobs.

Every version of every text is a blob, addressed by the SHA-256 of its content. Every rule has a version,
and the ledger, a table, holds which pairs of a blob and a rule's version have been scanned and what they
gave. Only pairs that it lacks are scanned, each blob's text moving once for all its pairs, and the findings
are joined back to all rows (paths, versions, copies) that hold the blob. A rule whose version changes is
scanned again, the others are not; findings of versions that are not asked for stay in the ledger unused.
Built from DataFrame functions alone.

A kind's matches are leftmost and non-overlapping. Their places come from the lengths of what stands
between them (``split``) and of the matches (``regexp_extract_all``), in code points.

Null texts are the empty blob, without findings. Texts of any length are scanned whole. Repeated rows
are rows of one blob. An empty table adds nothing to the ledger and gives no rows. Other columns are
ignored, whatever their names; ``redact`` counts ``n_chars`` anew only where there is such a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import cut


def _either(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


#: Kind -> (pattern, group that must be long, its least length); the first three are the base, in order.
ASSIGN = (
    f"({'|'.join(map(_either, ('password', 'passwd', 'secret', 'token')))}|{_either('api')}_?{_either('key')})"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
RULES = {
    "assign": (ASSIGN, 2, 8),
    "access": ("AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
}
BASE = ("assign", "access", "hex")
#: The version of each rule as it stands above: raised whenever the rule changes.
VERSIONS = dict.fromkeys(RULES, 1)
SPANS = "array<struct<start:int,kind:int,end:int>>"
_BLOCK = 64


def running_totals(values: Column) -> Column:
    """For each element the sum of those before it; in two levels, so that long arrays stay cheap."""

    def exclusive(x: Column, start: Column) -> Column:
        full = F.aggregate(x, F.array(start), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
        return F.slice(full, F.lit(1), F.size(x))

    n = F.size(values)
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(n / _BLOCK).cast("int") - 1, F.lit(0))),
        lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v))
    parts = F.zip_with(blocks, exclusive(sums, F.lit(0)), exclusive)
    return F.when(n > 0, F.flatten(parts)).otherwise(F.array().cast("array<int>"))


def spans_of_kind(text: Column, kind: str) -> Column:
    """Spans of one kind, as (start, place of the kind among the rules, end), by start."""
    pattern, group, least = RULES[kind]
    number = list(RULES).index(kind)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda x: F.length(x))
    steps = F.zip_with(gaps, F.transform(hits, lambda x: F.length(x)), lambda g, h: g + h)
    starts = F.zip_with(running_totals(steps), gaps, lambda a, g: a + g)
    # [[start, match]] with what fails taken out, then as spans
    found = F.zip_with(starts, hits, lambda s, h: F.struct(s.alias("start"), h.alias("hit")))
    kept = F.filter(found, lambda x: F.length(F.regexp_extract(x["hit"], pattern, group)) >= least)
    spans = F.transform(
        kept,
        lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), (x["start"] + F.length(x["hit"])).alias("end")),
    ).cast(SPANS)
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast(SPANS))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _pair(kind: str, version: int) -> str:
    return f"{kind}@{version}"


def scan_blobs(rows: DataFrame, ledger: DataFrame | None = None, versions: dict[str, int] = VERSIONS) -> DataFrame:
    """New rows of the ledger (blob, pairs, spans, n_rows): what it lacks of ``rows`` (text).

    ``pairs`` are the rules, with their versions, that were scanned just now, ``spans`` what they gave and
    ``n_rows`` how many of the rows hold the blob. Copies are dropped before a text moves.
    """
    blobs = rows.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("content"))
    blobs = blobs.groupBy("blob").agg(F.first("content").alias("content"), F.count("*").alias("n_rows"))
    wanted = F.array(*(F.lit(_pair(k, v)) for k, v in versions.items()))
    if ledger is None:
        blobs = blobs.withColumn("pairs", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("pairs")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("pairs", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        blobs = blobs.where(F.size("pairs") > 0)
    none = F.array().cast(SPANS)
    found = [F.when(F.array_contains("pairs", _pair(k, v)), spans_of_kind(F.col("content"), k)).otherwise(none) for k, v in versions.items()]
    return blobs.select("blob", "pairs", F.array_sort(F.concat(*found)).alias("spans"), "n_rows")


def extend_ledger(rows: DataFrame, ledger: DataFrame | None = None, versions: dict[str, int] = VERSIONS) -> tuple[DataFrame, DataFrame]:
    """The ledger (blob, pairs, spans, n_rows) with what it lacked of ``rows``, and that part alone; both are tables."""
    new = cut(scan_blobs(rows, ledger, versions))
    return (new if ledger is None else ledger.select(*new.columns).unionByName(new)), new


def known_findings(ledger: DataFrame, versions: dict[str, int] = VERSIONS) -> DataFrame:
    """(blob, spans) of the blobs that have findings under these versions of the rules, by start.

    A row of the ledger holds findings of the pairs it names only: what a kind gave is taken from the rows
    that name its version.
    """
    current = F.array(*(F.when(F.array_contains("pairs", _pair(k, v)), F.lit(list(RULES).index(k))) for k, v in versions.items()))
    valid = F.filter("spans", lambda s: F.array_contains(F.array_compact(current), s["kind"]))
    found = ledger.where(F.size("spans") > 0).select("blob", valid.alias("spans"))
    return found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).where(F.size("spans") > 0)


def findings(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """(whole, blob, spans): each row of ``rows`` as one value, with its blob's findings, empty where there are none.

    Findings are written before they are joined, so that a blob that many rows hold can be split by
    adaptive execution.
    """
    found = cut(known_findings(ledger), narrow=True)
    # a row travels as one value, so that its columns may have any names
    held = rows.select(F.struct(*rows.columns).alias("whole"), blob_of(F.col("text")).alias("blob"))
    return held.join(found, "blob", "left").select("whole", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in RULES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the findings of each document, and its blob."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ledger, _ = extend_ledger(rows)
    found = findings(rows, ledger)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == list(RULES).index(k))).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        F.col("whole.doc_id").alias("doc_id"), *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"), F.lower(F.hex("blob")).alias("blob"),
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(span(last["start"], F.greatest(last["end"], s["end"]))))
        return F.when((F.size(done) > 0) & (s["start"] < last["end"]), joined).otherwise(F.concat(done, F.array(span(s["start"], s["end"]))))

    # try_element_at: the last of an empty list is null
    whole = F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), lambda d, s: _safe_merge(d, s, merge))
    before = F.transform(whole, lambda s, i: F.concat(F.substring(text, _from(whole, i) + 1, s["start"] - _from(whole, i)), F.lit(mark)))
    rest = F.substring(text, F.coalesce(F.try_element_at(whole, F.lit(-1))["end"], F.lit(0)) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(before, ""), rest)).otherwise(text)


def _from(whole: Column, i: Column) -> Column:
    return F.coalesce(F.get(whole, i - 1)["end"], F.lit(0))


def _safe_merge(done: Column, s: Column, merge) -> Column:
    first = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(F.size(done) == 0, first).otherwise(merge(done, s))


def redact(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``docs``, all columns and rows, with secrets replaced in ``text`` and ``n_chars`` counted anew."""
    ledger, _ = extend_ledger(docs.select("text"), ledger)
    found = findings(docs, ledger)
    text = F.col("whole.text")
    found = found.withColumn("new", F.when(F.size("spans") > 0, redacted(text, F.col("spans"))).otherwise(text))
    kept = {c: F.col(f"whole.`{c}`") for c in docs.columns}
    kept["text"] = F.col("new")
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.size("spans") > 0, F.length("new").cast("long")).otherwise(kept["n_chars"])
    return found.select(*(value.alias(c) for c, value in kept.items()))


def oracle() -> str:
    parts = []
    for n, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        p = pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, '{kind}' AS kind, {n} AS number, {group} AS grp, {least} AS least, '{p}' AS pattern, "
            f"string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits, "
            f"regexp_extract_all(t, '{p}', {group}) AS grouped FROM d WHERE regexp_matches(t, '{p}')"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({' UNION ALL '.join(parts)}),
i AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM k),
s AS (
  SELECT rid, kind, number, hits[i] AS hit, grouped[i] AS g, least,
         CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM i
),
f AS (SELECT rid, kind, number, start, start + length(hit) AS stop FROM s WHERE length(g) >= least),
a AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) FILTER (number < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) AS spans
  FROM f GROUP BY rid
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN a USING (rid)
"""
