"""The manifest of source files: what is parsed again and what not, and the loader on top of it."""

from __future__ import annotations

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.sources.manifest import Manifest, news_manifest


def put(folder, name, rows, header="Time,Open,High,Low,Close,Volume", when=None):
    path = folder / name
    path.write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")
    if when:
        os.utime(path, (when, when))
    return path


def bars(day, price=1.0):
    return [f"2024-01-{day:02d} {h:02d}:00:00,{price},{price + 1},{price - 1},{price + 0.5},10" for h in range(3)]


@pytest.fixture
def source(spark, tmp_path):
    folder = tmp_path / "prices"
    folder.mkdir()
    put(folder, "AAA.csv", bars(2), when=1_700_000_000)
    put(folder, "BBB.csv", ["10,2024-01-03 05:00:00,7,5,6,8"], "Volume,Time,Close,Low,Open,High", when=1_700_000_000)
    return folder, Manifest(spark, str(tmp_path / "store"))


def rows(m, folder):
    return sorted((r.symbol, str(r.ts), r.open, r.high, r.low, r.close, r.volume) for r in m.table(str(folder)).collect())


def test_second_load_parses_nothing(source):
    folder, m = source
    first = m.load(str(folder))
    assert (first.listed, first.hashed, first.parsed) == (2, 2, 2)
    assert rows(m, folder)[-1] == ("BBB", "2024-01-03 05:00:00", 6.0, 8.0, 5.0, 7.0, 10.0) and len(rows(m, folder)) == 4
    second = m.load(str(folder))
    assert (second.listed, second.hashed, second.parsed) == (2, 0, 0)
    assert m.files().count() == 2


def test_changed_new_touched_copied_and_vanished_files(source):
    folder, m = source
    m.load(str(folder))
    # changed: read again, the old rows no longer show
    put(folder, "AAA.csv", bars(5, 50.0), when=1_700_000_100)
    assert (lambda x: (x.listed, x.hashed, x.parsed))(m.load(str(folder))) == (2, 1, 1)
    assert {r[2] for r in rows(m, folder) if r[0] == "AAA"} == {50.0}
    # touched: hashed, not parsed
    os.utime(folder / "BBB.csv", (1_700_000_200, 1_700_000_200))
    assert (lambda x: (x.hashed, x.parsed))(m.load(str(folder))) == (1, 0)
    # a copy under another name shares the rows
    (folder / "CCC.csv").write_bytes((folder / "AAA.csv").read_bytes())
    assert (lambda x: (x.hashed, x.parsed))(m.load(str(folder))) == (1, 0)
    a, b = ([r[1:] for r in rows(m, folder) if r[0] == s] for s in ("AAA", "CCC"))
    assert a == b and len(a) == 3
    # back to a content seen before: nothing to parse, the old rows show again
    put(folder, "AAA.csv", bars(2), when=1_700_000_300)
    assert (lambda x: (x.hashed, x.parsed))(m.load(str(folder))) == (1, 0)
    assert {r[2] for r in rows(m, folder) if r[0] == "AAA"} == {1.0}
    os.unlink(folder / "BBB.csv")
    assert {r[0] for r in rows(m, folder)} == {"AAA", "CCC"}


def test_a_batch_without_manifest_does_not_count(spark, source):
    folder, m = source
    m.load(str(folder))
    digest = m.files().first().digest
    orphan = spark.createDataFrame([(digest, pd.Timestamp("2030-01-01").to_pydatetime(), 1.0, 1.0, 1.0, 1.0, 1.0)], m.schema)
    orphan.write.parquet(f"{m.store}/rows/batch=orphan")
    assert len(rows(m, folder)) == 4


def test_empty_and_odd_files(source):
    folder, m = source
    (folder / "EMPTY.csv").write_text("")
    put(folder, "HEAD.csv", [])
    put(folder, "ODD.csv", ["not a time,1,2,3,4,5", "2024-01-09 00:00:00,x,2,3,4,"])
    assert m.load(str(folder)).listed == 4
    found = [r for r in rows(m, folder) if r[0] in ("EMPTY", "HEAD", "ODD")]
    assert found == [("ODD", "2024-01-09 00:00:00", None, 2.0, 3.0, 4.0, None)]


def test_news(spark, tmp_path):
    folder = tmp_path / "news"
    folder.mkdir()
    put(folder, "a.csv", ["2024-01-02 10:00:00,USD,red,Jobs"], "Date,Currency,Impact,Event")
    put(folder, "b.csv", ["Rates,EUR,yellow,2024-01-03"], "event,ccy,impact,timestamp")
    m = news_manifest(spark, str(tmp_path / "store"))
    assert m.load(str(folder)).parsed == 2
    assert sorted((r.currency, r.impact, r.event) for r in m.table(str(folder)).collect()) == [("EUR", "yellow", "Rates"), ("USD", "red", "Jobs")]
    put(folder, "c.csv", ["1"], "what")
    with pytest.raises(ValueError):
        m.load(str(folder))


def test_load_instrument(spark, tmp_path):
    """Half past nine in New York, session hours in local time, news, split, and costs, against pandas."""
    folder = tmp_path / "prices"
    folder.mkdir()
    ts = pd.date_range("2024-03-06", "2024-03-16", freq="15min", tz="UTC")
    put(folder, "X.csv", [f"{t:%Y-%m-%d %H:%M:%S},{k},{k + 2},{k - 1},{k + 1},1" for k, t in enumerate(ts)])
    m = Manifest(spark, str(tmp_path / "store"))
    m.load(str(folder))
    table = m.table(str(folder))
    ny = files.Instrument("America/New_York", 0.5, (0.1, 0.2), ("USD",), half_past=True)
    news = spark.createDataFrame([(pd.Timestamp("2024-03-07 15:00").to_pydatetime(), "USD", "red", "Jobs")], "ts timestamp, currency string, impact string, event string")
    every, train, after, spread, commission = files.load_instrument(table, ny, "2 hours", split_time="2024-03-12", session_hours=(9, 15), news=news, indicator=lambda d: d.withColumn("twice", F.col("close") * 2))
    assert (spread, commission) == (0.5, (0.1, 0.2))
    got = every.orderBy("ts").toPandas()
    pdf = pd.DataFrame({"open": range(len(ts)), "volume": 1.0}, index=ts.tz_convert("America/New_York").tz_localize(None)).assign(close=lambda d: d.open + 1)
    want = pdf.resample("2h", origin=pd.Timestamp("2000-01-01 09:30")).agg({"open": "first", "close": "last", "volume": "sum"}).dropna()
    want = want[(want.volume > 0) & (want.index.hour >= 9) & (want.index.hour <= 15)]
    assert got.close.tolist() == want.close.tolist() and got.twice.tolist() == (2 * want.close).tolist()
    local = got.ts.dt.tz_localize("UTC").dt.tz_convert("America/New_York").dt.tz_localize(None)
    assert local.tolist() == want.index.tolist() and set(local.dt.strftime("%H:%M")) == {"09:30", "11:30", "13:30", "15:30"}
    assert train.count() + after.count() == every.count() and after.agg(F.min("ts")).first()[0] >= pd.Timestamp("2024-03-12").to_pydatetime()
    assert got[got.news == 1].ts.dt.date.nunique() >= 1 and got.news.sum() < len(got)
    plain = files.load_instrument(table, ny, "2 hours", use_offset=False)
    assert {r.ts.minute for r in plain[0].collect()} == {0} and plain[2].count() == 0
