"""Time buckets: resampling of bars, returns and equity, calendar schedules, alignment in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resample_ohlc(bars: DataFrame, rule: str, offset: str = "0 seconds") -> DataFrame:
    """OHLCV in buckets of ``rule`` (``15 minutes``, ``1 day``), closed and labelled left; no empty ones."""
    start = F.window("ts", rule, rule, offset)["start"]
    return bars.groupBy("symbol", start.alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("bucket", "ts")


def resample_returns(returns: DataFrame, unit: str = "MONTH") -> DataFrame:
    """Compound returns per calendar unit: prod(1 + r) - 1 over what is not null."""
    rows = returns.where(F.col("ret").isNotNull()).groupBy("asset", F.date_trunc(unit, "ts").alias("ts"))
    return rows.agg((F.product(1 + F.col("ret")) - 1).alias("ret"))


def resample_last(df: DataFrame, key: str, value: str, unit: str = "DAY") -> DataFrame:
    """The last value of each calendar unit."""
    return df.groupBy(key, F.date_trunc(unit, "ts").alias("ts")).agg(F.max_by(value, "ts").alias(value))


def resample_frame(df: DataFrame, key: str, unit: str = "DAY") -> DataFrame:
    """Any frame by calendar unit: true where a boolean was ever true, of everything else the last."""
    kinds = dict(df.dtypes)
    values = [c for c in df.columns if c not in (key, "ts")]
    how = [F.bool_or(c).alias(c) if kinds[c] == "boolean" else F.max_by(c, "ts").alias(c) for c in values]
    return df.groupBy(key, F.date_trunc(unit, "ts").alias("ts")).agg(*how)


def rebalance_dates(df: DataFrame, unit: str = "QUARTER") -> DataFrame:
    """The last date that exists in each calendar unit."""
    return df.groupBy(F.date_trunc(unit, "ts").alias("period")).agg(F.max("ts").alias("ts"))


def rebalance_schedule(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """(ts, strategies): the dates on which any strategy rebalances, each by its own unit, and which do."""
    out = None
    for strategy, unit in units.items():
        part = rebalance_dates(df, unit).select("ts", F.lit(strategy).alias("strategy"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("ts").agg(F.array_sort(F.collect_set("strategy")).alias("strategies"))


def annualization_factor(df: DataFrame, key: str, days: int = 252) -> DataFrame:
    """Median number of rows per day, times the trading days of a year."""
    per_day = df.groupBy(key, F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return per_day.groupBy(key).agg((F.median("n") * days).alias("factor"))


def asof_backward(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right row at or before its time: one sort of the union, no join.

    Equal times count as before. Partitions are those of ``key``; nothing grows with the product.
    """
    blank = {v: F.lit(None) for v in values}
    marked = left.withColumns(blank).withColumn("_side", F.lit(1))
    other = right.select(key, "ts", *values).withColumn("_side", F.lit(0))
    kinds = dict(right.dtypes)
    marked = marked.withColumns({v: F.col(v).cast(kinds[v]) for v in values})
    order = Window.partitionBy(key).orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    packed = F.last(F.when(F.col("_side") == 0, F.struct(*values)), ignorenulls=True).over(order)
    both = marked.unionByName(other, allowMissingColumns=True).withColumn("_found", packed)
    return both.where(F.col("_side") == 1).withColumns({v: F.col("_found")[v] for v in values}).drop("_side", "_found")


def asof_forward(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Each left row with the first right row at or after its time."""
    negative = lambda df: df.withColumn("_at", F.col("ts")).withColumn("ts", -F.unix_micros(F.col("ts").cast("timestamp")))
    renamed = negative(right.select(key, "ts", *values)).drop("_at")
    out = asof_backward(negative(left), renamed, key, values)
    return out.withColumn("ts", F.col("_at")).drop("_at")


def align_higher(base: DataFrame, coarse: DataFrame, values: list[str], suffix: str) -> DataFrame:
    """Features of a coarser frame on base bars: of the last bucket that was complete before each bar."""
    order = Window.partitionBy("symbol").orderBy("ts")
    shifted = coarse.select("symbol", "ts", *(F.lag(v).over(order).alias(f"{v}{suffix}") for v in values))
    return asof_backward(base, shifted, "symbol", [f"{v}{suffix}" for v in values])


def mark_news(
    bars: DataFrame, news: DataFrame, n_bars: int = 1, timezone: str = "US/Eastern",
    currencies: tuple[str, ...] = ("USD",), impacts: tuple[str, ...] = ("red", "High Impact Expected"),
) -> DataFrame:
    """Bars with ``news``: 1 within ``n_bars`` of an event's bar and on the local day of a bank holiday.

    An event falls on the bar at its time or else on the next one; holidays take the whole local day.
    """
    low = lambda xs: [x.lower() for x in xs]
    wanted = news.where(F.lower("currency").isin(low(currencies)))
    holiday = F.lower("event").contains("bank holiday")
    local = lambda c: F.to_date(F.from_utc_timestamp(c, timezone))
    days = wanted.where(holiday).select(local("ts").alias("day")).distinct()
    events = wanted.where(F.lower("impact").isin(low(impacts)) & ~holiday).select("ts").distinct()
    # an event concerns every symbol: a bar is hit where more events have come by its time than by the bar before it
    dated = events.groupBy(F.to_date("ts").alias("_date")).agg(F.collect_list("ts").alias("_times"), F.count("*").alias("_n"))
    dates = bars.select(F.to_date("ts").alias("_date")).union(dated.select("_date")).distinct()
    earlier = Window.orderBy("_date").rowsBetween(Window.unboundedPreceding, -1)  # a calendar: one row per date
    calendar = dates.join(dated, "_date", "left").select("_date", "_times", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    come = F.col("_before") + F.coalesce(F.array_size(F.filter("_times", lambda t: t <= F.col("ts"))), F.lit(0))
    counted = bars.withColumn("_date", F.to_date("ts")).join(calendar, "_date").withColumn("_come", come).drop("_date", "_times", "_before")
    by_time = Window.partitionBy("symbol").orderBy("ts")
    hit = F.when(F.col("_come") > F.coalesce(F.lag("_come").over(by_time), F.lit(0)), 1)
    near = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-n_bars, n_bars)
    marked = counted.withColumns({"_hit": hit, "day": local("ts")}).join(days.withColumn("_day", F.lit(1)), "day", "left")
    flag = F.greatest(F.coalesce("_hit", F.lit(0)), F.coalesce("_day", F.lit(0)))
    return marked.withColumn("_flag", flag).withColumn("news", F.max("_flag").over(near)).drop("_flag", "_hit", "_day", "day", "_come")


def global_month(ts: str | Column, first_year: Column) -> Column:
    return (F.year(ts) - first_year) * 12 + F.month(ts)


def extend_with_next_month(returns: DataFrame) -> DataFrame:
    """Per asset one more row, of return 0, at the start of the month after the last."""
    ends = returns.groupBy("asset").agg(F.max("ts").alias("last"))
    more = ends.select("asset", F.add_months(F.date_trunc("MONTH", "last"), 1).cast("timestamp").alias("ts"), F.lit(0.0).alias("ret"))
    return returns.select("asset", "ts", "ret").join(more, ["asset", "ts"], "left_anti").unionByName(more)


def attach_by_local_time(bars: DataFrame, values: DataFrame, columns: list[str], timezone: str = "Europe/Berlin", at: str = "09:00") -> DataFrame:
    """Values of an entry's local day on the bar at a fixed local time; 0 on all other bars."""
    hour, minute = map(int, at.split(":"))
    day = F.date_trunc("DAY", F.from_utc_timestamp("entry_time", timezone))
    stamp = F.to_utc_timestamp(day + F.make_interval(hours=F.lit(hour), mins=F.lit(minute)), timezone)
    right = values.withColumn("ts", stamp).groupBy("symbol", "ts").agg(*(F.max_by(c, "entry_time").alias(c) for c in columns))
    return bars.join(right, ["symbol", "ts"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})
