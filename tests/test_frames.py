"""Operators on frames that no query covers: files, joins in time, splits, streams."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.functions import scalars as S
from tidemark.operators import resample as R
from tidemark.operators import splits as SP
from tidemark.operators import windows as W
from tidemark.sources import files
from tidemark.sources import views as V
from tidemark.streaming import live


def at(hour: int, minute: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, 2, hour, minute)


def test_price_and_strategy_files(spark, tmp_path):
    (tmp_path / "US500.csv").write_text("DATE,Open,HIGH,low,Close,Volume\n2024-01-02 00:10:00,1,3,0.5,2,10\n2024-01-02 00:40:00,2,4,1,3,20\nbad,1,1,1,1,1\n")
    bars = files.read_bars(spark, str(tmp_path / "US500.csv"))
    assert [(r.symbol, r.open, r.volume) for r in bars.orderBy("ts").collect()] == [("US500", 1.0, 10.0), ("US500", 2.0, 20.0)]
    everything, train, oos = files.load_security(bars, "1 hour", split_time="2024-01-02 00:30:00")
    row = everything.first()
    assert (row.open, row.high, row.low, row.close, row.volume) == (1.0, 4.0, 0.5, 3.0, 30.0) and train.count() == 1 and oos.count() == 0
    (tmp_path / "a_equity.csv").write_text("date,equity\n2024-01-01,100\n2024-01-05,101\n")
    (tmp_path / "a_trades.csv").write_text("EntryTime,PnL\n2024-01-05 10:00:00,1\n")
    equity, trades = files.read_strategy_files(spark, str(tmp_path), "2024-01-02")
    assert [(r.strategy, r.equity) for r in equity.collect()] == [("a", 101.0)] and trades.count() == 1
    (tmp_path / "r.csv").write_text("d,A,B\n2024-01-01,0.1,\n")
    assert {(r.asset, r.ret) for r in files.read_returns(spark, str(tmp_path / "r.csv")).collect()} == {("A", 0.1), ("B", None)}
    (tmp_path / "n.csv").write_text("Datetime,ccy,Impact,Event\n2024-01-01,USD,red,CPI\n")
    assert files.read_news(spark, str(tmp_path / "n.csv")).first().currency == "USD"
    (tmp_path / "bad.csv").write_text("Datetime,Impact\n2024-01-01,red\n")
    with pytest.raises(ValueError, match="currency"):
        files.read_news(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "c.json").write_text(json.dumps({"x": 1}))
    assert files.read_config(str(tmp_path / "c.json")) == {"x": 1}
    files.write_table(equity, str(tmp_path / "out"), by=["strategy"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_asof_both_ways(spark):
    left = spark.createDataFrame([("a", at(h)) for h in (1, 3, 5)], "symbol string, ts timestamp")
    right = spark.createDataFrame([("a", at(2), 2.0), ("a", at(3), 3.0), ("b", at(0), 9.0)], "symbol string, ts timestamp, v double")
    assert [r.v for r in R.asof_backward(left, right, "symbol", ["v"]).orderBy("ts").collect()] == [None, 3.0, 3.0]
    assert [r.v for r in R.asof_forward(left, right, "symbol", ["v"]).orderBy("ts").collect()] == [2.0, 3.0, None]


def test_local_time_join(spark):
    bars = spark.createDataFrame([("a", at(7)), ("a", at(8))], "symbol string, ts timestamp")
    values = spark.createDataFrame([("a", at(15), 0.7)], "symbol string, entry_time timestamp, p double")
    assert [r.p for r in R.attach_by_local_time(bars, values, ["p"]).orderBy("ts").collect()] == [0.0, 0.7]


def test_frames_by_day(spark):
    df = spark.createDataFrame([("a", at(1), True, 1), ("a", at(2), False, 2)], "k string, ts timestamp, flag boolean, n int")
    r = R.resample_frame(df, "k").first()
    assert r.flag is True and r.n == 2


def test_combinatorial_splits_do_not_leak(spark):
    days = spark.range(900).select((F.timestamp_seconds(F.lit(1_577_836_800) + F.col("id") * 86_400)).alias("ts"), F.col("id").alias("x"))
    split = SP.CombinatorialPurged(test_months=3, test_groups=2, paths=4).split(days)
    for path in range(4):
        rows = split.where(F.col("path") == path).collect()
        test = {r.x for r in rows if r.role == "test"}
        train = {r.x for r in rows if r.role == "train"}
        assert test and train and not test & train
        assert all(min(abs(a - b) for b in test) >= 5 for a in train)


def test_chunks_give_the_same_windows(spark):
    bars = V.bars(spark, f"{DATA}/sf0.001")
    key = lambda df: sorted((r.symbol, r.ts, round(r.bb_mid or 0, 9), round(r.williams_r or 0, 9)) for r in df.select("symbol", "ts", "bb_mid", "williams_r").collect())
    work = lambda df: W.williams_r(W.bollinger(df))
    assert key(W.by_chunks(bars, work, 10 * 86_400, 9 * 86_400)) == key(work(bars))


def test_bet_sizes(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.9,)], "p double")
    found = [r[0] for r in df.select(S.probability_to_bet_size(F.col("p"))).collect()]
    assert found[0] < 0.01 and abs(found[1] - 0.6826895) < 1e-5 and found[2] > 0.99
    assert df.select(S.kelly_size(F.col("p"), F.lit(1.0), 0.5)).collect()[2][0] == pytest.approx(0.4)


def stream(spark, df, tmp_path, build, schema):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(3).write.parquet(source)
    out = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(sink)


def test_live_bars_equal_batch_bars(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    found = stream(spark, events, tmp_path, lambda s: live.live_bars(s, late="400 days"), live.EVENTS)
    batch = V.bars(spark, f"{DATA}/sf0.001")
    live_rows = {(r.symbol, r.ts): r.close for r in found.collect()}
    batch_rows = {(r.symbol, r.ts): r.close for r in batch.collect()}
    # what the watermark has not passed yet is still open
    assert all(batch_rows[k] == v for k, v in live_rows.items())


def test_live_average_and_drawdown(spark, tmp_path):
    bars = spark.createDataFrame([("a", at(h), float(h)) for h in range(1, 6)], "symbol string, ts timestamp, close double").coalesce(1)
    found = stream(spark, bars, tmp_path / "x", lambda s: live.live_ewm(s, 0.5), "symbol string, ts timestamp, close double")
    assert found.count() == 5
    equity = spark.createDataFrame([("s", at(1), 100.0), ("s", at(2), 90.0)], "strategy string, ts timestamp, equity double").coalesce(1)
    found = stream(spark, equity, tmp_path / "y", lambda s: live.live_drawdown(s), "strategy string, ts timestamp, equity double")
    assert found.count() == 2
