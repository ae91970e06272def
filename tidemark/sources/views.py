"""Research tables derived from raw tables: bars, returns, equity, trades, news, trials, folds, features.

Each view exists twice: as a DataFrame built from Spark operators, and as the text of the same view in
DuckDB's SQL (``SQL``), from which the oracles of registered queries are composed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, rule: str = "HOUR") -> DataFrame:
    """OHLCV bars per symbol: a bar opens with its first event and closes with its last."""
    events = read(spark, sf_dir, "events").select("event_type", "ts", "value", "event_id")
    order = F.struct("ts", "event_id")
    return events.groupBy(F.col("event_type").alias("symbol"), F.date_trunc(rule, "ts").alias("ts")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, ts, ret) with ragged dates."""
    daily = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").alias("ts"))
    return daily.agg(((F.avg("o_totalprice") - 250000.0) / 10000000.0).alias("ret"))


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, ts, ret, equity): returns compounded from 100 000."""
    path = Window.partitionBy("asset").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return returns(spark, sf_dir).withColumn("equity", 100000 * F.exp(F.sum(F.log(1 + F.col("ret"))).over(path)))


#: A total order of the trade ledger: line numbers alone are not unique.
TRADE_ORDER = ("entry_time", "entry_bar", "l_linenumber", "l_partkey", "strategy", "l_extendedprice")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of closed trades; ``strategy`` is the partition of all per-strategy operators."""
    line = read(spark, sf_dir, "lineitem")
    t = line.select(
        F.col("l_suppkey").alias("strategy"), "l_linenumber", "l_partkey", "l_extendedprice",
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("size"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("entry_price"),
        F.col("l_tax"), F.col("l_discount"),
        (0.0001 * F.col("l_extendedprice")).alias("commission"),
        F.col("l_shipdate").alias("entry_time"), F.col("l_orderkey").alias("entry_bar"),
        (F.col("l_linenumber") % 3).alias("entry_regime"), F.col("l_quantity").alias("entry_indicator"),
    )
    t = t.withColumn("exit_price", F.col("entry_price") * (1 + F.col("l_tax") - F.col("l_discount")))
    t = t.withColumn("sl", F.col("entry_price") * F.when(F.col("size") > 0, 0.98).otherwise(1.02))
    t = t.withColumn("pnl", F.col("size") * (F.col("exit_price") - F.col("entry_price")) - F.col("commission"))
    return t.withColumn("return_pct", F.col("pnl") / (F.abs("size") * F.col("entry_price"))).drop("l_tax", "l_discount")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar events: red and yellow impacts, now and then a bank holiday."""
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    return e.select(
        "ts", F.lit("USD").alias("currency"),
        F.when(F.col("event_type") == "error", "red").otherwise("yellow").alias("impact"),
        F.when(F.col("event_id") % 97 == 0, "Bank Holiday").otherwise(F.col("event_type")).alias("event"), "event_id",
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished optimiser trials with two parameters."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("number"), "p_size", "p_brand", (F.col("p_retailprice") / 100).alias("score"),
        F.when(F.col("p_partkey") % 11 == 0, "PRUNED").otherwise("COMPLETE").alias("state"),
    )


#: Returns are added up as whole numbers of this part of one.
RETURN_UNITS = 1e10


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and ratio of trade returns per (parameter set, fold).

    Returns are rounded to whole numbers of 1e-10 and these and their squares are added exactly: every task sends three
    sums for each pair, and equal returns have equal scores however their rows are dealt. So ranks go by the scores,
    then by the next key, and not by the last digits of a sum.
    """
    t = trades(spark, sf_dir).select(F.col("strategy").alias("param_id"), F.col("l_linenumber").alias("fold"), "return_pct")
    q = F.when(~F.isnan("return_pct"), F.floor(F.col("return_pct") * RETURN_UNITS + 0.5)).cast("decimal(18, 0)")
    k, total, squares = F.count("q"), F.sum("q").cast("decimal(19, 0)"), F.sum(F.col("q") * F.col("q")).cast("decimal(38, 0)")
    g = t.withColumn("q", q).groupBy("param_id", "fold").agg(k.alias("k"), total.alias("total"), squares.alias("squares"), F.count("*").alias("n"))
    spread = (F.col("k").cast("decimal(10, 0)") * F.col("squares") - F.col("total") * F.col("total")).cast("double")
    mean = F.try_divide(F.col("total").cast("double"), F.col("k").cast("double")) / RETURN_UNITS
    pairs = F.col("k").cast("double") * (F.col("k").cast("double") - 1)
    g = g.withColumns({"mean_ret": mean, "sd_ret": F.sqrt(F.try_divide(spread, pairs)) / RETURN_UNITS})
    return g.select("param_id", "fold", "mean_ret", "sd_ret", "n", F.try_divide("mean_ret", "sd_ret").alias("sharpe"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long features (id, feature, value, label) out of the embeddings."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.posexplode("embedding").alias("feature", "value"), (F.col("label") % 2).alias("label")
    ).withColumn("value", F.col("value").cast("double"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole embeddings (id, label, x, part): of ten rows six train, two are for watching and two for testing, by a hash of the id."""
    e = read(spark, sf_dir, "embeddings")
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(10))
    part = F.when(draw < 6, "train").when(draw < 8, "dev").otherwise("test")
    return e.select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("label"), F.col("embedding").cast("array<double>").alias("x"), part.alias("part"))


#: The same views in DuckDB's SQL.
SQL = {
    "v_bars": """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
 min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""",
    "v_returns": """SELECT o_orderpriority AS asset, o_orderdate AS ts, (avg(o_totalprice) - 250000.0) / 10000000.0 AS ret
 FROM orders GROUP BY 1, 2""",
    "v_equity": """SELECT asset, ts, ret, 100000 * exp(sum(ln(1 + ret)) OVER (PARTITION BY asset ORDER BY ts
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS equity FROM v_returns""",
    "v_trades0": """SELECT l_suppkey AS strategy, l_linenumber, l_partkey, l_extendedprice,
 CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS size, l_extendedprice / l_quantity AS entry_price,
 (l_extendedprice / l_quantity) * (1 + l_tax - l_discount) AS exit_price, 0.0001 * l_extendedprice AS commission, l_shipdate AS entry_time,
 l_orderkey AS entry_bar, l_linenumber % 3 AS entry_regime, l_quantity AS entry_indicator FROM lineitem""",
    "v_trades": """SELECT *, entry_price * CASE WHEN size > 0 THEN 0.98 ELSE 1.02 END AS sl, size * (exit_price - entry_price) - commission AS pnl,
 (size * (exit_price - entry_price) - commission) / (abs(size) * entry_price) AS return_pct FROM v_trades0""",
    "v_news": """SELECT ts, 'USD' AS currency, CASE WHEN event_type = 'error' THEN 'red' ELSE 'yellow' END AS impact,
 CASE WHEN event_id % 97 = 0 THEN 'Bank Holiday' ELSE event_type END AS event, event_id FROM events WHERE event_type IN ('error', 'signup')""",
    "v_trials": """SELECT p_partkey AS number, p_size, p_brand, p_retailprice / 100 AS score,
 CASE WHEN p_partkey % 11 = 0 THEN 'PRUNED' ELSE 'COMPLETE' END AS state FROM part""",
    "v_folds": """SELECT *, mean_ret / nullif(sd_ret, 0) AS sharpe FROM (SELECT param_id, fold, total::DOUBLE / nullif(k, 0)::DOUBLE / 1e10 AS mean_ret,
 sqrt((k * squares - total * total)::DOUBLE / nullif(k::DOUBLE * (k - 1), 0)) / 1e10 AS sd_ret, n FROM (SELECT param_id, fold, count(q)::HUGEINT AS k, sum(q)::HUGEINT AS total,
 sum(q::HUGEINT * q) AS squares, count(*) AS n FROM (SELECT strategy AS param_id, l_linenumber AS fold,
 CASE WHEN NOT isnan(return_pct) THEN floor(return_pct * 1e10 + 0.5)::BIGINT END AS q FROM v_trades) GROUP BY 1, 2))""",
    "v_features": """SELECT vec_id AS id, i - 1 AS feature, CAST(embedding[i] AS DOUBLE) AS value, label % 2 AS label
 FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
}
_NEEDS = {"v_equity": ["v_returns"], "v_trades": ["v_trades0"], "v_folds": ["v_trades0", "v_trades"]}


def oracle(body: str, *views: str) -> str:
    """``body`` with the named views, and what they need, as common table expressions before it."""
    names: list[str] = []
    for v in views:
        names += [x for x in [*_NEEDS.get(v, []), v] if x not in names]
    text = body.strip()
    head = ",\n".join(f"{v} AS ({SQL[v]})" for v in names)
    return f"WITH {head},\n{text[5:]}" if text.upper().startswith("WITH ") else f"WITH {head}\n{text}"


def epoch(column: str = "ts"):
    """Time as whole seconds: the same value in every engine."""
    return F.unix_timestamp(F.col(column)).alias(column)
