"""Train and test partitions as interval tables: folds are small relations, rows are never copied to plan them."""

from __future__ import annotations

import itertools
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col


def three_way(train_end: str, test_end: str) -> Column:
    """train up to the first time, test up to the second, live after it."""
    a, b = F.lit(train_end).cast("timestamp"), F.lit(test_end).cast("timestamp")
    return F.when(c("ts") <= a, "train").when(c("ts") <= b, "test").otherwise("live")


def month_code(ts: str = "ts", first_year: int = 0) -> Column:
    return (F.year(ts) - first_year) * 12 + F.month(ts)


@dataclass(frozen=True)
class MonthWalkForward:
    """Rolling or anchored month windows: in-sample, embargo, out-of-sample."""

    in_months: int = 10
    out_months: int = 3
    step: int = 0
    offset: int = 0
    embargo: int = 0
    anchored: bool = False

    def windows(self, first: int, last: int) -> list[tuple[int, int, int, int, int]]:
        """(fold, train from, train to, test from, test to) in month codes, ends inclusive."""
        out, start = [], first + self.offset
        while True:
            train_to = start + self.in_months - 1
            test_from = train_to + 1 + self.embargo
            test_to = test_from + self.out_months - 1
            if test_to > last:
                return out
            out.append((len(out), first + self.offset if self.anchored else start, train_to, test_from, test_to))
            start += self.step or self.out_months

    def folds(self, df: DataFrame) -> DataFrame:
        """The fold relation of the table's months."""
        a, b = df.agg(F.min(month_code()), F.max(month_code())).first()
        rows = self.windows(a, b) if a is not None else []
        return df.sparkSession.createDataFrame(rows, "fold int, train_from int, train_to int, test_from int, test_to int")

    def split(self, df: DataFrame) -> DataFrame:
        """Rows with (fold, role): a range join with the fold relation, which has one row per fold."""
        return _with_roles(df.withColumn("_m", month_code()), self.folds(df), c("_m")).drop("_m")

    def latest_train(self, df: DataFrame, expand: bool = False) -> DataFrame:
        last = df.agg(F.max(month_code())).first()[0]
        if last is None or expand:
            return df
        return df.where(month_code() > last - self.in_months)


def _with_roles(df: DataFrame, folds: DataFrame, at: Column) -> DataFrame:
    # a fold relation holds a row per fold, whatever the table's size
    small = F.broadcast(folds)
    inside = at.between(c("train_from"), c("train_to")) | at.between(c("test_from"), c("test_to"))
    role = F.when(at.between(c("test_from"), c("test_to")), "test").otherwise("train")
    return df.join(small, inside).withColumn("role", role).drop("train_from", "train_to", "test_from", "test_to")


def merge_intervals(df: DataFrame, *keys: str) -> DataFrame:
    """Union of overlapping intervals (start, end) per key: gaps and islands."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", (before.isNull() | (c("start") > before)).cast("int"))
    df = df.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def optimal_folds(spark: SparkSession, n: int, train_size: int, paths: int, most: int = 100) -> DataFrame:
    """(n_folds, n_test) with the least relative error of path count and train size."""
    a = spark.range(3, most + 1).select(c("id").cast("int").alias("n_folds"))
    grid = a.withColumn("n_test", F.explode(F.sequence(F.lit(2), c("n_folds") - 1)))
    # C(n, k) k / n paths, by logarithms of factorials
    log_factorial = [0.0]
    for k in range(1, most + 1):
        log_factorial.append(log_factorial[-1] + math.log(k))
    table = F.array(*(F.lit(x) for x in log_factorial))
    ways = F.exp(F.get(table, c("n_folds")) - F.get(table, c("n_test")) - F.get(table, c("n_folds") - c("n_test")))
    got_paths = ways * c("n_test") / c("n_folds")
    got_train = n * (c("n_folds") - c("n_test")) / c("n_folds")
    cost = F.abs(got_paths / paths - 1) + F.abs(got_train / train_size - 1)
    return grid.agg(F.min_by(F.struct("n_folds", "n_test"), F.struct(cost, c("n_folds"), c("n_test"))).alias("best")).select("best.*")


@dataclass(frozen=True)
class CombinatorialPurged:
    """Combinatorial purged cross-validation over groups of months."""

    test_months: int = 6
    test_groups: int = 2
    paths: int = 5
    purge_days: int = 5
    embargo_days: int = 5
    seed: int | None = 42

    def groups(self, df: DataFrame) -> list[tuple]:
        """Contiguous half-open month groups inside the table's time."""
        first, last = df.agg(F.min("ts"), F.max("ts")).first()
        out = []
        if first is None:
            return out
        at = first.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
        while True:
            month = at.year * 12 + at.month - 1 + self.test_months
            end = at.replace(year=month // 12, month=month % 12 + 1)
            if end > last:
                return out
            out.append((at, end))
            at = end

    def combinations(self, n: int) -> list[tuple[int, ...]]:
        """Test groups of each path: drawn with the seed, each on its own, or else in order."""
        if self.seed is None:
            return list(itertools.islice(itertools.combinations(range(n), self.test_groups), self.paths))
        rng = random.Random(self.seed)
        return [tuple(sorted(rng.sample(range(n), self.test_groups))) for _ in range(self.paths)] if n >= self.test_groups else []

    def relations(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(path, fold, start, end) of the tests, and (path, start, end) of what training leaves out."""
        import datetime as dt

        groups = self.groups(df)
        tests, left_out = [], []
        for path, picked in enumerate(self.combinations(len(groups))):
            for fold, g in enumerate(picked):
                a, b = groups[g]
                tests.append((path, fold, a, b))
                purge = dt.timedelta(days=0 if g - 1 in picked else self.purge_days)
                embargo = dt.timedelta(days=0 if g + 1 in picked else self.embargo_days)
                left_out.append((path, a - purge, b + embargo))
        spark = df.sparkSession
        t = spark.createDataFrame(tests, "path int, fold int, start timestamp, end timestamp")
        x = spark.createDataFrame(left_out, "path int, start timestamp, end timestamp")
        return t, merge_intervals(x, "path")

    def split(self, df: DataFrame) -> DataFrame:
        """Rows with (path, fold, role); training rows have fold -1 and lie outside of all left-out intervals."""
        tests, left_out = self.relations(df)
        inside = (c("ts") >= c("start")) & (c("ts") < c("end"))
        test = df.join(F.broadcast(tests), inside).drop("start", "end").withColumn("role", F.lit("test"))
        paths = tests.select("path").distinct()
        train = df.crossJoin(F.broadcast(paths)).alias("d").join(
            F.broadcast(left_out.alias("x")), (c("d.path") == c("x.path")) & inside, "left_anti"
        )
        return test.unionByName(train.withColumn("fold", F.lit(-1)).withColumn("role", F.lit("train")).select(*test.columns))


    def split_with_holdout(self, df: DataFrame, share: float = 0.2) -> DataFrame:
        """The split of all but the last ``share`` of the rows in time, which come once, as (path -1, fold -1, hold-out)."""
        every = Window.orderBy("ts")
        times = df.groupBy("ts").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, 0)))
        cut = times.agg(F.max_by("ts", F.when(c("_upto") <= F.lit(1 - share) * F.lit(df.count()), c("ts")))).first()[0]
        if cut is None:
            return self.split(df)
        rest = df.where(c("ts") > F.lit(cut)).withColumns({"path": F.lit(-1), "fold": F.lit(-1), "role": F.lit("holdout")})
        inside = self.split(df.where(c("ts") <= F.lit(cut)))
        return inside.unionByName(rest.select(*inside.columns))

    @staticmethod
    def of_path(split: DataFrame, path: int) -> DataFrame:
        """The training rows of a path, each once, and the rows of its tests."""
        own = split.where(c("path") == path)
        train = own.where(c("role") == "train").dropDuplicates()
        return train.unionByName(own.where(c("role") == "test"))


def holdout(df: DataFrame, share: float, key: str) -> DataFrame:
    """The last ``share`` of each key's rows as hold-out."""
    w = Window.partitionBy(key)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("ts"))
    return df.withColumn("role", F.when(i <= F.floor(n * (1 - share)), "fit").otherwise("holdout"))


def entry_time_bounds(trades: DataFrame, key: str, order: tuple[str, ...], train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Times up to which train and validation reach, by shares of the ordered trades."""
    w = Window.partitionBy(key)
    rows = trades.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(*order)))
    upto = lambda share: F.max(F.when(c("_i") <= F.floor(c("_n") * share), c("entry_time")))
    return rows.groupBy(key).agg(upto(train).alias("train_end"), upto(train + val).alias("val_end"))
