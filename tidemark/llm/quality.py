"""Host-level quality rules: failures of simple rules are counted by host, their rates are shrunk with an
empirical beta prior, and the hosts' verdicts go back to the documents.

Words are runs of anything but blanks (space, tab, line breaks). A document fails ``short`` (too few words),
``repeats`` (too many words in three-word windows that occur twice or more), ``symbols`` (too many of ``#*$%&|<>``),
``lines`` (too many lines equal to an earlier one) or ``length`` (mean word too short or too long). The first two
are the base: a document that fails one of them is not kept. For every rule, the rates of all hosts of two or more
documents give a beta prior by its first two moments (the second from pairs of documents, so that small hosts do not
inflate it); a host whose shrunk rate lies above the rule's limit fails it, and none of its documents is kept.

Rates are added as decimals: the prior does not depend on the order of rows. Hosts that hold more than a thousandth
of all documents, fewer than a thousand by that, are broadcast; the documents of all others meet their hosts by a
shuffle, in which no host has more than that thousandth. The driver sees one row.

Null texts have no words and fail ``short`` only. Documents of a null host are judged by themselves. Texts of any length are
read whole. Repeated rows count as documents of their own and give repeated results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import by_piece, texts_of
from tidemark.llm.storage import cut

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Rule -> what a document fails it by, in the columns of ``measure_documents``. The first two are the base.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}
BASE = ("short", "repeats")
#: Rule -> the shrunk rate above which a host fails it.
LIMITS = {"short": 0.75, "repeats": 0.5, "symbols": 0.5, "lines": 0.5, "length": 0.5}
#: Least and greatest weight of the prior, in documents.
WEIGHTS = (4.0, 1000.0)
#: Hosts with more than one of so many documents are broadcast.
PART = 1000


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    pairs = np.unique(ids[:-2] * len(known) + ids[1:-1], return_inverse=True)[1]
    _, window, times = np.unique(pairs * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of one text; only lines with a word count."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if not (not line or line.isspace())]
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), repeated_words(words),
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def measure_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, counts) of every row; one pass, nothing moves."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(zip(*map(measure, texts_of(batch)), strict=True)) or [()] * len(COUNTS)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array(x, pa.int64()) for x in found)], ["doc_id", "host", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    return rows.mapInArrow(by_piece(work, "text"), "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


class Prior(NamedTuple):
    """Weight in documents, and the mean rate."""

    weight: float
    mean: float


def _exact(x: Column) -> Column:
    return x.cast("decimal(20, 12)")


def fit_priors(hosts: DataFrame, rules: dict[str, str], weights: tuple[float, float] = WEIGHTS) -> tuple[int, dict[str, Prior]]:
    """All documents of hosts, and each rule's prior, from (host, n, one count per rule)."""
    several, n = F.col("n") > 1, F.col("n").cast("double")
    sums = [F.sum("n").alias("docs"), F.count(F.when(several, 1)).alias("hosts")]
    for rule in rules:
        k = F.col(rule).cast("double")
        sums.append(F.sum(rule).alias(f"all_{rule}"))
        sums.append(F.sum(F.when(several, _exact(k / n))).alias(f"first_{rule}"))
        sums.append(F.sum(F.when(several, _exact(F.try_divide(k * (k - 1), n * (n - 1))))).alias(f"second_{rule}"))
    row, least, most = hosts.agg(*sums).first(), *weights
    priors = {}
    for rule in rules:
        if not row.docs or not row.hosts:
            priors[rule] = Prior(least, row[f"all_{rule}"] / row.docs if row.docs else 0.0)
            continue
        mean, second = float(row[f"first_{rule}"]) / row.hosts, float(row[f"second_{rule}"]) / row.hosts
        spread = second - mean * mean
        weight = mean * (1 - mean) / spread - 1 if spread > 0 else most
        priors[rule] = Prior(min(max(weight, least), most), mean)
    return row.docs or 0, priors


def failing_hosts(hosts: DataFrame, priors: dict[str, Prior], limits: dict[str, float]) -> DataFrame:
    """(host, n, host_rules): the rules that hosts fail by their shrunk rates, comma-joined; other hosts are left out."""
    names = []
    for rule, (weight, mean) in priors.items():
        rate = (F.col(rule) + F.lit(weight * mean)) / (F.col("n") + F.lit(weight))
        names.append(F.when(rate > F.lit(limits[rule]), F.lit(rule)))
    return hosts.select("host", "n", F.concat_ws(",", *names).alias("host_rules")).where("host_rules <> ''")


def judge_documents(
    docs: DataFrame, host: str = "source", rules: dict[str, str] = RULES, limits: dict[str, float] = LIMITS, weights: tuple[float, float] = WEIGHTS
) -> DataFrame:
    """(doc_id, host, counts, base_failed, rules_failed, host_rules, kept) of every row.

    Texts are read once: their counts are a table in the shared folder.
    """
    rows = cut(measure_documents(docs, host))
    failed = {rule: F.expr(condition) for rule, condition in rules.items()}
    hosts = cut(rows.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *(F.count(F.when(x, 1)).alias(r) for r, x in failed.items())), narrow=True)
    total, priors = fit_priors(hosts, rules, weights)
    large = hosts.where(F.col("n") * PART > total)
    verdicts = failing_hosts(hosts, priors, limits).select("host", "n", "host_rules")
    named = rows.join(F.broadcast(large.select("host", F.lit(True).alias("large"))), "host", "left")
    seen = F.coalesce("large", F.col("host").isNull())
    one = named.where(seen).join(F.broadcast(verdicts.where(F.col("n") * PART > total).drop("n")), "host", "left")
    other = named.where(~seen).join(verdicts.where(F.col("n") * PART <= total).drop("n").hint("merge"), "host", "left")
    base = F.lit(False)
    for rule in BASE:
        base = base | failed[rule]
    return one.unionByName(other).select(
        "doc_id", "host", *COUNTS, base.alias("base_failed"), F.concat_ws(",", *(F.when(x, F.lit(r)) for r, x in failed.items())).alias("rules_failed"),
        F.coalesce("host_rules", F.lit("")).alias("host_rules"), (~base & F.col("host_rules").isNull()).alias("kept"),
    )


def _sql_prior(rule: str) -> str:
    return f"""SELECT '{rule}' AS rule, CASE WHEN coalesce(hosts, 0) = 0 THEN {WEIGHTS[0]} WHEN second_{rule} - mean_{rule} * mean_{rule} > 0
      THEN least(greatest(mean_{rule} * (1 - mean_{rule}) / (second_{rule} - mean_{rule} * mean_{rule}) - 1, {WEIGHTS[0]}), {WEIGHTS[1]}) ELSE {WEIGHTS[1]} END AS weight,
      CASE WHEN coalesce(hosts, 0) > 0 THEN mean_{rule} WHEN docs > 0 THEN all_{rule}::DOUBLE / docs ELSE 0 END AS mean FROM sums"""


def oracle() -> str:
    """DuckDB's SQL of the query; the rules' conditions are the same text."""
    counts = ", ".join(f"count(*) FILTER ({c}) AS {r}" for r, c in RULES.items())
    sums = ", ".join(
        f"sum({r})::DOUBLE AS all_{r}, sum(({r}::DOUBLE / n)::DECIMAL(20, 12)) FILTER (n > 1)::DOUBLE / nullif(count(*) FILTER (n > 1), 0) AS mean_{r}, "
        f"sum((({r}::DOUBLE * ({r} - 1)) / nullif(n::DOUBLE * (n - 1), 0))::DECIMAL(20, 12)) FILTER (n > 1)::DOUBLE / nullif(count(*) FILTER (n > 1), 0) AS second_{r}"
        for r in RULES
    )
    rates = ", ".join(
        f"CASE WHEN ({r} + (SELECT weight * mean FROM priors WHERE rule = '{r}')) / (n + (SELECT weight FROM priors WHERE rule = '{r}')) > {LIMITS[r]} THEN '{r}' END" for r in RULES
    )
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts
), windows AS (
  SELECT row, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM cut)
), again AS (
  SELECT row, unnest([i, i + 1, i + 2]) AS place FROM (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS times FROM windows) WHERE times > 1
), repeated AS (
  SELECT row, count(DISTINCT place) AS n_repeat_words FROM again GROUP BY row
), counted AS (
  SELECT doc_id, host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM cut LEFT JOIN repeated USING (row)
), hosts AS (
  SELECT host, count(*) AS n, {counts} FROM counted WHERE host IS NOT NULL GROUP BY host
), sums AS (
  SELECT sum(n) AS docs, count(*) FILTER (n > 1) AS hosts, {sums} FROM hosts
), priors AS (
  {" UNION ALL ".join(map(_sql_prior, RULES))}
), judged AS (
  SELECT host, concat_ws(',', {rates}) AS host_rules FROM hosts
), verdicts AS (
  SELECT counted.*, {" OR ".join(f"({RULES[r]})" for r in BASE)} AS base_failed, coalesce(host_rules, '') AS host_rules FROM counted LEFT JOIN judged USING (host)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND host_rules = '' AS kept, host_rules FROM verdicts
"""
