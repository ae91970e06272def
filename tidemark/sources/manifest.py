"""A manifest of source files: each version of a file is read once, whoever asks for it.

Files are listed by path, time of change and length, which reads no content. Those not yet known so are hashed (SHA-256 of their bytes); only
contents that no file had before are parsed, grouped by header line, so that files with other names or orders of columns are read by their
own header. Parsed rows are Parquet under the store, by batch; a batch counts once the manifest names it, so that a load that
failed leaves nothing behind that anyone sees. A table is the rows of the files as they are listed now: a changed file shows its new
content, one that is gone none, and two files of equal content share one copy of the rows.

The store lies in a folder that all executors reach. Files are at most 2 GB each. The driver holds the names of new and changed files.
Loads of one store follow each other; readers may read while one runs. Files of no bytes are not listed, files with a header alone give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.files import PRICES

c = F.col
FILES = "path string, changed timestamp, length long, digest string, header string, batch string, seen long"


def _time(column: str):
    return F.try_to_timestamp(F.col(f"`{column}`"))


def parse_bars(raw: DataFrame) -> DataFrame:
    """Prices of CSV rows read as text, columns lower-cased; the time is ``time`` or else the first column."""
    time = "time" if "time" in raw.columns else raw.columns[0]
    value = lambda n: F.col(n).try_cast("double") if n in raw.columns else F.lit(None).cast("double")
    return raw.select("digest", _time(time).alias("ts"), *(value(n).alias(n) for n in PRICES)).where(c("ts").isNotNull())


def parse_news(raw: DataFrame) -> DataFrame:
    """Calendar rows, with their columns under their usual names; files that lack one are an error."""
    names = {"ts": ("date", "datetime", "time", "timestamp"), "currency": ("currency", "ccy"), "impact": ("impact",), "event": ("event",)}
    found = {k: next((n for n in v if n in raw.columns), None) for k, v in names.items()}
    if lacking := [k for k, n in found.items() if n is None]:
        raise ValueError(f"the calendar lacks {lacking}")
    return raw.select("digest", _time(found["ts"]).alias("ts"), *(F.col(found[k]).alias(k) for k in ("currency", "impact", "event")))


@dataclass
class Loaded:
    """What a load did: files listed, hashed, and contents parsed."""

    listed: int
    hashed: int
    parsed: int


@dataclass
class Manifest:
    """The files of one kind of table. ``schema`` is that of the parsed rows, with ``digest`` first."""

    spark: SparkSession
    store: str
    parse: Callable[[DataFrame], DataFrame] = parse_bars
    schema: str = "digest string, ts timestamp, " + ", ".join(f"{n} double" for n in PRICES)

    def _read(self, name: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.store}/{name}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.store}/{name}")

    def files(self) -> DataFrame:
        """All versions of all files ever seen, each with the number of the load that saw it."""
        return self._read("files", FILES)

    def _listed(self, path: str) -> DataFrame:
        return self.spark.read.format("binaryFile").load(path).select("path", c("modificationTime").alias("changed"), "length")

    def load(self, path: str) -> Loaded:
        """Brings the store up to date with the files of ``path``, a file, folder or pattern."""
        known, listed = self.files(), self._listed(path)
        fresh = listed.join(known.select("path", "changed", "length").distinct(), ["path", "changed", "length"], "left_anti")
        names = [r.path for r in fresh.select("path").collect()]
        if not names:
            return Loaded(listed.count(), 0, 0)
        number, batch = (known.agg(F.max("seen")).first()[0] or 0) + 1, uuid.uuid4().hex
        text = F.substring("content", 1, 65_536).cast("string")
        hashed = self.spark.read.format("binaryFile").load(names).select("path", c("modificationTime").alias("changed"), "length", F.sha2("content", 256).alias("digest"), F.regexp_extract(text, r"^\x{FEFF}?([^\r\n]*)", 1).alias("header"))
        seen = [tuple(r) for r in hashed.collect()]
        new = {s[3]: s for s in sorted(seen)}
        for r in known.select("digest").where(c("digest").isin(list(new))).distinct().collect():
            new.pop(r.digest, None)
        headers: dict[str, dict[str, str]] = {}
        for path_, _, _, digest, header in new.values():
            if header.strip():
                headers.setdefault(header, {})[path_] = digest
        for header, of in headers.items():
            raw = self.spark.read.option("header", True).csv(list(of)).withColumn("_path", c("_metadata.file_path"))
            digests = self.spark.createDataFrame([(p, d) for p, d in of.items()], "_path string, digest string")
            rows = raw.toDF(*(n.strip().lstrip("\ufeff").lower() for n in raw.columns)).join(F.broadcast(digests), "_path").drop("_path")
            self.parse(rows).write.mode("append").parquet(f"{self.store}/rows/batch={batch}")
        # the manifest comes last: with it, the batch counts
        versions = self.spark.createDataFrame([(*s, batch, number) for s in seen], FILES)
        versions.coalesce(1).write.mode("append").parquet(f"{self.store}/files")
        return Loaded(listed.count(), len(seen), len(new))

    def table(self, path: str) -> DataFrame:
        """(symbol, path, ...): the rows of the files that ``path`` lists now; the symbol is the file's name without its ending."""
        latest = Window.partitionBy("path").orderBy(c("seen").desc())
        versions = self.files().withColumn("_place", F.row_number().over(latest)).where("_place = 1").select("path", "digest")
        now = versions.join(self._listed(path).select("path"), "path")
        counted = self.files().select("digest", "batch").distinct()
        rows = self._read("rows", f"{self.schema}, batch string").join(counted, ["digest", "batch"]).drop("batch")
        symbol = F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
        columns = [f.strip().split()[0] for f in self.schema.split(",")][1:]
        return rows.join(now, "digest").select(symbol.alias("symbol"), "path", *columns)


def news_manifest(spark: SparkSession, store: str) -> Manifest:
    return Manifest(spark, store, parse_news, "digest string, ts timestamp, currency string, impact string, event string")
