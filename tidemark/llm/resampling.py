"""Importance resampling towards a target: hashed n-gram counts tell how much likelier a document is there.

Texts are lower-cased (A-Z only) and cut into words of digits, letters and everything beyond ASCII. All runs of
1 to ``order`` consecutive words, joined by one space, are features; the CRC-32 of a feature's UTF-8 bytes,
modulo ``buckets``, is its bucket. A bucket's gain is the floored thousandfold log ratio of its share in the
target to its share in the source, each with one more feature a bucket; a document's weight is the floored mean
of its gains. Its score adds Gumbel noise, made from its id and the seed, so that the documents of highest score are
a sample without replacement in proportion to exp(weight / 1000).

Scoring explodes nothing: higher-order functions make each document's array of buckets and add up the entries of
one constant array of gains. What moves are the counts of the buckets, one number for each bucket and task, and
for the ranks the narrow rows (id and three numbers) of the documents at or above the least drawn score.

The driver holds the two tables of counts (``buckets`` numbers each) and a histogram of scores: these are integers
between the least and the greatest gain, give or take the noise (-3 130 to 22 873), so it has some ten thousand
entries however many documents there are.

Null texts have no words: no features, weight 0. Documents with fewer than ``least`` words are scored but never
drawn. A null id gives noise like the empty string and comes first among ties. Rows alike in score and id follow
each other in no particular order. Texts of any length are read whole. Repeated rows are repeated in the result and
each has a rank of its own; empty tables give empty results, and with an empty target every gain is that of no
evidence. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import cut

#: What stands between words: ASCII without digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 1
BUCKETS = 10_000
#: Words that a document must have to be drawn, the percentage that is drawn, and the seed of the noise.
LEAST = 20
PERCENT = 10
SEED = 2024


def _lowered(word: Column) -> Column:
    """A-Z lower-cased; words of ASCII alone, which most are, go the quick way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words_of(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), BETWEEN)
    return F.transform(F.filter(parts, lambda w: w != ""), _lowered)


def features_of(words: Column, order: int = ORDER) -> Column:
    """All runs of 1 to ``order`` words."""
    if order == 1:
        return words
    runs = [words]
    for n in range(2, order + 1):
        runs.append(F.transform(_starts(words, n), _run_of(words, n)))
    return F.concat(*runs)


def _starts(words: Column, n: int) -> Column:
    """The words that begin a run of ``n``."""
    return F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))


def _run_of(words: Column, n: int) -> Callable[[Column, Column], Column]:
    return lambda _, i: F.array_join(F.slice(words, i + 1, F.lit(n)), " ")


def buckets_of(features: Column, buckets: int = BUCKETS) -> Column:
    return F.transform(features, lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int"))


def bucket_arrays(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, buckets): the bucket of every feature of every row."""
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    return words.select("doc_id", F.size("words").alias("n_words"), buckets_of(features_of(F.col("words"), order), buckets).alias("buckets"))


def bucket_counts(arrays: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features fall into each bucket; every task sends one number per bucket."""
    found = arrays.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect()
    counts = [0] * buckets
    for row in found:
        counts[row.bucket] = row["count"]
    return counts


def gains_of(source: list[int], target: list[int]) -> list[int]:
    """Floored thousandfold log ratio of each bucket's smoothed shares, in doubles."""
    n, whole, whole_target = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (whole + n) / ((s + 1.0) * (whole_target + n)))) for s, t in zip(source, target, strict=True)]


def _literal(gains: list[int]) -> Column:
    """One constant array; a column per entry would make plans as long as the list."""
    return F.split(F.lit(",".join(map(str, gains))), ",").cast("array<int>")


def weight_of(buckets: Column, gains: list[int]) -> Column:
    """Floored mean of the gains of a document's buckets."""
    table = _literal(gains)
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))
    n = F.size(buckets).cast("long")
    whole = ((total - F.pmod(total, F.greatest(n, F.lit(1)))) / F.greatest(n, F.lit(1))).cast("long")
    return F.when(n > 0, whole).otherwise(F.lit(0).cast("long"))


def noise_of(doc_id: Column, seed: int = SEED) -> Column:
    """Floored thousandfold Gumbel noise from the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")


class Cutoff(NamedTuple):
    """How many documents are drawn, the least score among them, and the number of documents above each score that is."""

    drawn: int
    score: int | None
    above: list[tuple[int, int]]


def cutoff_of(scored: DataFrame, percent: int = PERCENT, least: int = LEAST) -> Cutoff:
    """From the histogram of the scores of documents of enough words (columns n_words, score)."""
    found = sorted(((r.score, r["count"]) for r in scored.where(F.col("n_words") >= least).groupBy("score").count().collect()), reverse=True)
    wanted = percent * sum(n for _, n in found) // 100
    above, seen = [], 0
    for score, n in found:
        if seen >= wanted:
            break
        above.append((score, seen))
        seen += n
    return Cutoff(wanted, above[-1][0] if above else None, above)


def rank_draws(scored: DataFrame, cutoff: Cutoff, least: int = LEAST) -> DataFrame:
    """``scored`` (doc_id, n_words, n_features, weight, score) with ``rank``, null where a row is not drawn.

    Rows from the cutoff on are dealt by score. Those alike are counted before they move, so that no score holds more
    rows than it has ids.
    """
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    if cutoff.score is None:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    high = (F.col("n_words") >= least) & (F.col("score") >= cutoff.score)
    rest = scored.where(~high).select(*names, F.lit(None).cast("long").alias("rank"))
    above = scored.sparkSession.createDataFrame(cutoff.above, "score long, above long")
    alike = scored.where(high).groupBy(*names).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id"), "weight", "n_features", "n_words").rowsBetween(Window.unboundedPreceding, 0)
    upto = alike.withColumn("upto", F.sum("copies").over(order)).join(F.broadcast(above), "score")
    last = F.col("above") + F.col("upto")
    ranked = upto.select(*names, F.explode(F.sequence(last - F.col("copies") + 1, last)).alias("rank"))
    return rest.unionByName(ranked.withColumn("rank", F.when(F.col("rank") <= cutoff.drawn, F.col("rank"))))


def fit_gains(arrays: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> list[int]:
    """Gains of all buckets from the arrays of the source and the texts of the target."""
    texts = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    return gains_of(bucket_counts(arrays, buckets), bucket_counts(bucket_arrays(texts, order, buckets), buckets))


def score_documents(arrays: DataFrame, gains: list[int], seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``bucket_arrays``; nothing moves."""
    weighed = arrays.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight_of(F.col("buckets"), gains).alias("weight"))
    return weighed.withColumn("score", F.col("weight") + noise_of(F.col("doc_id"), seed))


def resample_documents(
    docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``; ranks of the drawn ones only.

    The bucket arrays and the scores are tables in the shared folder, so that texts are cut into words once.
    """
    arrays = cut(bucket_arrays(docs, order, buckets))
    scored = cut(score_documents(arrays, fit_gains(arrays, target, order, buckets), seed))
    return rank_draws(scored, cutoff_of(scored, percent, least), least)


ORACLE_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps
), texts AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), goals AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), held AS (
  SELECT row, unnest(words) AS word FROM texts
), known AS (
  SELECT word, hex(word) AS digits FROM (SELECT word FROM held UNION SELECT word FROM goals)
), placed AS (
  SELECT word, xor(list_reduce(list_transform(range(1, len(digits), 2), lambda k: ('0x' || substr(digits, k, 2))::BIGINT),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM known, crc
), counts AS (
  SELECT bucket, sum(s) AS s, sum(t) AS t, (SELECT count(*) FROM held) AS s_all, (SELECT count(*) FROM goals) AS t_all
  FROM (SELECT word, 1 AS s, 0 AS t FROM held UNION ALL SELECT word, 0, 1 FROM goals) JOIN placed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS gain FROM counts
), weights AS (
  SELECT row, floor(sum(gain) / count(*)) AS weight FROM held JOIN placed USING (word) JOIN gains USING (bucket) GROUP BY row
), scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE))))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (row)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place,
    (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) AS drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM ranked
"""
