"""URL filters by a tree of path templates.

Every host has a tree of its paths, one level per segment. Level by level, a place with more than ``kinds``
different segments is variable and becomes a wildcard, but for segments with labels enough to tell that
their share of bad pages differs from their siblings'. Elsewhere segments stay, but branches whose share
does not differ (a two-sided test of proportions against the siblings) are merged into one, written
``(de|en)``. Each template that remains has a purity, the smoothed share of bad pages among its labelled
ones, and is rejected from a threshold on. Given rules go before templates.

Trees are built from distinct (host, path) rows with their counts, so hot hosts and repeated pages are
summed before they move; a parent's sums meet its branches on (parent, salt), and names and verdicts are
written before they meet the paths, so that adaptive execution can split a template with many paths.

Null urls and urls without ``://`` have an empty host and path and belong to the template of the empty
host. Every level that exists is judged, but a template with fewer than ``least`` pages and without labels
of both kinds stops there: what is left of its paths is ``*``, one for each segment. Repeated rows count
and are judged one by one, null page ids among them; without labels nothing is rejected; empty tables give
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import cut

#: (verdict, host, path): fits the host and all its subdomains where the path begins so; the longest wins.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SALTS = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(f"{h}{p}")).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def templates(paths: DataFrame, kinds: int = 12, support: int = 8, z: float = 1.96, least: int = 8) -> DataFrame:
    """The template of each row of ``paths`` (host, path, n, labelled, bad), as a column ``template``.

    Under a parent with more than ``kinds`` different segments, one that holds at least ``support`` labelled
    pages and whose share of bad pages differs from its siblings' by ``z`` standard errors stays; the others
    are ``*``. Under any other parent all segments stay, those that do not differ so as one branch.
    """
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    tree = cut(paths.withColumn("segments", segments).withColumn("template", F.col("host")))
    columns = [*paths.columns, "template"]
    salt = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    sums = ("n", "labelled", "bad")
    done: DataFrame | None = None
    tree = tree.withColumn("open", F.lit(True))
    level = 0
    while True:
        left = F.size("segments") - level
        closed = tree.where(~F.col("open") | (left <= 0))
        closed = closed.withColumn("template", F.concat("template", F.repeat(F.lit("/*"), F.greatest(left, F.lit(0))))).select(*columns)
        done = closed if done is None else done.unionByName(closed)
        tree = tree.where(F.col("open") & (left > 0)).drop("open")
        if tree.isEmpty():
            return done
        at = F.get("segments", F.lit(level))
        branches = tree.select("template", at.alias("segment"), *sums).groupBy("template", "segment").agg(*(F.sum(c).alias(c) for c in sums))
        parents = branches.groupBy("template").agg(F.count("*").alias("kinds"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        salted = branches.withColumn("salt", F.pmod(F.xxhash64("segment"), F.lit(_SALTS)).cast("int"))
        both = salted.join(parents.withColumn("salt", salt), ["template", "salt"])
        rest, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        pooled = F.try_divide("all_bad", "all_labelled")
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), "labelled") + F.try_divide(F.lit(1.0), rest)))
        differs = F.coalesce(F.abs(F.try_divide("bad", "labelled") - F.try_divide(rest_bad, rest)) > z * error, F.lit(False))
        few = F.col("kinds") <= kinds
        # a segment holds no slash, so that the marks of merged branches are no segments
        kind = F.when(differs & (few | (F.col("labelled") >= support)), F.col("segment")).otherwise(F.when(few, "/few").otherwise("/many"))
        marked = both.select("template", "salt", "segment", *sums, kind.alias("kind"))
        # of the few at most ``kinds`` are listed
        listed = F.array_sort(F.collect_set(F.when(F.col("kind") != "/many", F.col("segment"))))
        merged = marked.groupBy("template", "kind").agg(*(F.sum(c).alias(f"{c}_here") for c in sums), listed.alias("listed"))
        name = F.when(F.col("kind") == "/many", "*").when(F.size("listed") == 1, F.get("listed", F.lit(0))).otherwise(F.concat(F.lit("("), F.array_join("listed", "|"), F.lit(")")))
        worth = (F.col("n_here") >= least) | ((F.col("bad_here") > 0) & (F.col("bad_here") < F.col("labelled_here")))
        merged = merged.select("template", "kind", name.alias("name"), worth.alias("open"))
        known = marked.select("template", "salt", "segment", "kind").join(merged.withColumn("salt", salt), ["template", "kind", "salt"])
        names = cut(known.select(F.col("template").alias("parent"), F.col("segment").alias("own"), "name", "open"), narrow=True)
        deeper = tree.join(names, (F.col("template") == F.col("parent")) & (at == F.col("own")))
        tree = cut(deeper.withColumn("template", F.concat_ws("/", "template", "name")).drop("parent", "own", "name"), narrow=True)
        level += 1


def judge_pages(
    pages: DataFrame, labels: DataFrame, rules=RULES, threshold: float = 0.5, prior_weight: float = 4.0, **options
) -> DataFrame:
    """Host, path, rule and verdict of each page; ``labels`` holds (page_id, bad 0/1), nulls ignored."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    known = labels.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    marked = parsed.join(known, "page_id", "left")
    counts = marked.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    tree = cut(templates(counts, **options))
    total = tree.agg(F.sum("bad"), F.sum("labelled")).first()
    prior = (total[0] or 0) / (total[1] or 1)
    purity = (F.col("bad") + prior_weight * prior) / (F.col("labelled") + prior_weight)
    judged = tree.groupBy("template").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    # a template is rejected on labels of its own only
    judged = judged.withColumn("purity", purity).withColumn("reject", (F.col("bad") > 0) & (F.col("purity") >= threshold))
    judged = cut(judged.select("template", "purity", "reject"), narrow=True)
    per_path = cut(tree.select("host", "path", "template").join(judged, "template"))
    out = parsed.join(per_path, ["host", "path"], "left")
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.coalesce("reject", F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "purity")


def page_labels(labels: DataFrame) -> DataFrame:
    """Labels of documents as labels of the pages with their ids: bad is low quality or toxic."""
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    return labels.select(F.col("doc_id").cast("long").alias("page_id"), bad.alias("bad"))
