"""File sources and sinks: price, news, strategy and return CSVs, configs, and result tables."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import learning, regimes
from tidemark.operators.resample import mark_news, resample_ohlc

PRICES = ("open", "high", "low", "close", "volume")


def _lowered(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip().lower() for c in df.columns))


def read_bars(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """One long bar table from one or many price CSVs; the time is ``time`` or else the first column.

    The symbol is the file's name unless it is given. All columns are read as text first and cast, so a
    header in any case and order is accepted.
    """
    raw = _lowered(spark.read.option("header", True).csv(path))
    time = "time" if "time" in raw.columns else raw.columns[0]
    name = F.lit(symbol) if symbol else F.regexp_extract(F.input_file_name(), r"([^/\\]+?)\.csv", 1)
    return raw.select(
        name.alias("symbol"), F.try_to_timestamp(F.col(time)).alias("ts"), *(F.col(c).try_cast("double").alias(c) for c in PRICES)
    ).where(F.col("ts").isNotNull())


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """The economic calendar with its columns under their usual names."""
    raw = _lowered(spark.read.option("header", True).csv(path))
    pick = lambda *names: next((n for n in names if n in raw.columns), None)
    time, currency = pick("date", "datetime", "time", "timestamp"), pick("currency", "ccy")
    missing = [n for n, c in (("date", time), ("currency", currency), ("impact", pick("impact")), ("event", pick("event"))) if c is None]
    if missing:
        raise ValueError(f"the calendar lacks {missing}")
    return raw.select(F.try_to_timestamp(F.col(time)).alias("ts"), F.col(currency).alias("currency"), "impact", "event")


def load_security(
    bars: DataFrame, rule: str | None = None, timezone: str | None = None, hours: tuple[str, str] | None = None,
    split_time: str | datetime | None = None, indicator=None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all, train, out-of-sample) bars: resampled, given indicators, cut to session hours, split in time."""
    out = resample_ohlc(bars, rule) if rule else bars
    if indicator is not None:
        out = out.transform(indicator)
    if hours:
        local = F.from_utc_timestamp("ts", timezone) if timezone else F.col("ts")
        out = out.where(F.date_format(local, "HH:mm").between(*hours))
    if split_time is None:
        return out, out, out.limit(0)
    at = F.lit(split_time).cast("timestamp")
    return out, out.where(F.col("ts") < at), out.where(F.col("ts") >= at)


@dataclass(frozen=True)
class Instrument:
    """What a broker says of a security: local time zone, costs, currencies of its news, and whether its intraday bars begin at half past nine."""

    timezone: str = "UTC"
    spread: float = 0.0
    commission: tuple[float, float] = (0.0, 0.0)
    currencies: tuple[str, ...] = ("USD",)
    half_past: bool = False


#: Hours of the rules whose bars begin at half past nine, where the instrument's do.
HALF_PAST_RULES = {"1 hour": 1, "2 hours": 2, "4 hours": 4}


def load_instrument(
    bars: DataFrame, instrument: Instrument, rule: str = "1 day", use_offset: bool = True, split_time: str | datetime | None = None, indicator=None,
    session_hours: tuple[int, int] | None = None, news: DataFrame | None = None, news_bars: int = 1, news_impacts: tuple[str, ...] = ("red", "High Impact Expected"),
) -> tuple[DataFrame, DataFrame, DataFrame, float, tuple[float, float]]:
    """(all, train, out-of-sample, spread, commission) of one instrument's bars, as ``Manifest.table`` or ``read_bars`` give them.

    Bars are resampled from midnight UTC, or where the instrument and the rule ask for it from 09:30 of local time; times stay in UTC.
    Indicators see all hours, the session's hours (both included) are local. With ``news``, bars near events are marked.
    """
    local = F.from_utc_timestamp("ts", instrument.timezone)
    if use_offset and instrument.half_past and rule in HALF_PAST_RULES:
        start = (9 * 60 + 30) % (60 * HALF_PAST_RULES[rule])
        shifted = resample_ohlc(bars.withColumn("ts", local), rule, f"{start} minutes")
        out = shifted.withColumn("ts", F.to_utc_timestamp("ts", instrument.timezone))
    else:
        out = resample_ohlc(bars, rule)
    if indicator is not None:
        out = out.transform(indicator)
    if session_hours:
        out = out.where(F.hour(local).between(*session_hours))
    if news is not None:
        out = mark_news(out, news, news_bars, instrument.timezone, instrument.currencies, news_impacts)
    at = F.lit(split_time).cast("timestamp")
    parts = (out, out.limit(0)) if split_time is None else (out.where(F.col("ts") < at), out.where(F.col("ts") >= at))
    return (out, *parts, instrument.spread, instrument.commission)


def read_strategy_files(spark: SparkSession, folder: str, start_date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Long (strategy, ts, equity) and trades tables out of ``*_equity.csv`` and ``*_trades.csv``."""

    def named(kind: str) -> DataFrame:
        raw = spark.read.option("header", True).csv(f"{folder}/*_{kind}.csv")
        return raw.withColumn("strategy", F.regexp_extract(F.input_file_name(), rf"([^/\\]+)_{kind}\.csv", 1))

    raw = named("equity")
    time, value = raw.columns[:2]
    equity = raw.select("strategy", F.try_to_timestamp(F.col(time)).alias("ts"), F.col(value).try_cast("double").alias("equity"))
    trades = named("trades")
    for c in trades.columns:
        if "date" in c.lower() or "time" in c.lower():
            trades = trades.withColumn(c, F.try_to_timestamp(F.col(c)))
    if start_date:
        at = F.lit(start_date).cast("timestamp")
        equity = equity.where(F.col("ts") >= at)
        if "EntryTime" in trades.columns:
            trades = trades.where(F.col("EntryTime") >= at)
    return equity, trades


def read_returns(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV of returns (first column the time) as long (ts, asset, ret)."""
    raw = spark.read.option("header", True).csv(path)
    time, *assets = raw.columns
    wide = raw.select(F.try_to_timestamp(F.col(time)).alias("ts"), *(F.col(f"`{a}`").try_cast("double").alias(a) for a in assets))
    return wide.unpivot("ts", assets, "asset", "ret")


def read_config(path: str) -> dict:
    """An experiment's JSON file (YAML where its parser is installed)."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yml", ".yaml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Metrics, allocations and audits as Parquet or CSV, in folders by ``by``."""
    out = df.write.mode("overwrite")
    if by:
        out = out.partitionBy(*by)
    out.option("header", True).format(kind).save(path)


#: Fitted models that can be written down, by the name that stands in their file.
MODELS = {m.__name__: m for m in (learning.Calibrator, learning.Forest, learning.Bag, regimes.HiddenMarkov, regimes.Ensemble)}


def save_model(spark: SparkSession, model, path: str) -> None:
    """A fitted model's parameters as one line of JSON, in a folder of any store that Spark reaches."""
    text = json.dumps({"kind": type(model).__name__, "state": model.state()})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str):
    """The model that ``save_model`` wrote, which predicts the same."""
    found = json.loads(spark.read.text(path, wholetext=True).first().value)
    return MODELS[found["kind"]].from_state(found["state"])
