"""Bars from and to delimited and JSON files. Wrong rows go to an error channel; they never end a read."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from ..functions.calendar import local, parse_naive, to_utc, zone
from ..model import BAR_KEY, BAR_SCHEMA

#: Header names that are understood (fixed values), without angle brackets, spaces and underscores.
ALIASES = {
    "date": "date", "time": "time", "datetime": "datetime", "timestamp": "datetime", "open": "open", "high": "high", "low": "low", "close": "close",
    "tickvol": "tick_volume", "tickvolume": "tick_volume", "vol": "volume", "volume": "volume", "realvolume": "volume", "spread": "spread",
}
POSITIONS = ["date", "time", "open", "high", "low", "close", "tick_volume", "volume", "spread"]
PRICES = ("open", "high", "low", "close")
EXTRAS = ("tick_volume", "volume", "spread")


def detect_delimiter(line: str) -> str:
    """The most frequent of tab, comma and semicolon; of equals the earlier."""
    return max("\t,;", key=lambda c: (line.count(c), -"\t,;".index(c)))


def peek(spark: SparkSession, path: str, n: int = 5) -> list[str]:
    """The first lines of a file."""
    return [r["value"] for r in spark.read.text(path).limit(n).collect()]


def has_header(line: str) -> bool:
    return "<" in line or not re.match(r"\s*[\"']?\d", line)


def header_map(names: list[str]) -> dict[str, int] | None:
    """Positions of known columns, if enough are known: five, with a time, open and close."""
    found: dict[str, int] = {}
    for k, name in enumerate(names):
        key = ALIASES.get(re.sub(r"[<>\s_]", "", name).lower())
        if key and key not in found:
            found[key] = k
    ok = len(found) >= 5 and ("date" in found or "datetime" in found) and "open" in found and "close" in found
    return found if ok else None


def number(text: Column) -> Column:
    """A number with a decimal point or comma and blanks inside; null if it is none."""
    return F.regexp_replace(F.regexp_replace(text, r"\s", ""), ",", ".").try_cast("double")


@dataclass
class BarRead:
    good: DataFrame
    bad: DataFrame  # file, number (from 1), line, error


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 1 in each file), line of text files. Lines are numbered inside the pieces that tasks
    read; only how many lines each piece has is gathered."""
    low = F.lit((1 << 33) - 1)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("__id"), F.col("value").alias("line"))
    lines = lines.withColumn("__piece", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(low))
    ends = lines.groupBy("file", "__piece").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    w = Window.partitionBy("file").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).select("file", "__piece", "__first", "__before")
    return lines.join(ends, ["file", "__piece"]).select("file", (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("number"), "line")


def _checked(bars: DataFrame) -> DataFrame:
    """``bars`` with ``error``: why a row is no bar, null if it is one."""
    missing = F.greatest(*(F.col(c).isNull().cast("int") for c in PRICES)) == 1
    outside = (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.col("high"))
    return bars.withColumn("error", F.when(F.col("ts").isNull(), "bad date").when(missing, "bad price").when(outside, "prices outside low..high"))


def _parser(spark: SparkSession, path: str, tz: str, delimiter: str | None) -> Callable[[DataFrame], DataFrame]:
    """What turns lines (column ``line``, others are kept) into checked bars, by the first line at ``path``."""
    head = peek(spark, path, 1)
    line = head[0] if head else ""
    sep = delimiter or detect_delimiter(line)
    header = has_header(line)
    names = [x.strip().strip('"') for x in line.split(sep)]
    places = (header_map(names) if header else None) or {c: k for k, c in enumerate(POSITIONS)}
    width = max(len(names), len(POSITIONS))
    schema = ", ".join(f"c{k} string" for k in range(width))
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    text = lambda c: F.col(f"c{places[c]}") if c in places else F.lit(None).cast("string")
    if "datetime" in places:
        whole = F.split(F.trim(text("datetime")), r"[ T]", 2)
        when = parse_naive(whole[0], F.coalesce(F.get(whole, F.lit(1)), F.lit("")))
    else:
        when = parse_naive(text("date"), text("time"))

    def parse(lines: DataFrame) -> DataFrame:
        rows = lines.filter((F.trim("line") != "") & ((F.col("line") != F.lit(line)) if header else F.lit(True))).withColumn("__c", F.from_csv("line", schema, options)).select(*lines.columns, "__c.*")
        rows = rows.filter(F.coalesce(*(F.nullif(F.col(f"c{k}"), F.lit("")) for k in range(width))).isNotNull())
        return _checked(rows.select(
            *lines.columns, to_utc(when, zone(tz)).alias("ts"), *(number(text(c)).alias(c) for c in PRICES), *(F.coalesce(number(text(c)), F.lit(0.0)).alias(c) for c in EXTRAS),
        ))

    return parse


def _in_range(bars: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        bars = bars.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return bars.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz")) if end else bars


def read_bars(spark: SparkSession, path: str, instrument: str, timeframe: str = "M1", tz: str = "UTC", start: str | None = None, end: str | None = None, delimiter: str | None = None) -> BarRead:
    """Typed bars of [start, end) in UTC, and the rows that are wrong: a date that is none, a price that
    is missing, or prices outside low..high."""
    parse = _parser(spark, path, tz, delimiter)
    bars = parse(spark.read.text(path).withColumnRenamed("value", "line"))
    good = bars.filter("error IS NULL").select(F.lit(instrument).alias("instrument"), F.lit(timeframe).alias("timeframe"), "ts", *PRICES, *EXTRAS)
    return BarRead(_in_range(good, start, end), parse(numbered_lines(spark, path)).filter("error IS NOT NULL").select("file", "number", "line", "error"))


def read_json_bars(spark: SparkSession, path: str, instrument: str, timeframe: str = "M1", tz: str = "UTC") -> BarRead:
    """Bars from JSON records; the time is epoch seconds or milliseconds (by magnitude) or text. Records that are no bar are kept with their error."""
    schema = "ts string, time string, datetime string, date string, open double, high double, low double, close double, tick_volume double, tickVolume double, volume double, spread double"
    raw = numbered_lines(spark, path).filter(F.trim("line") != "").withColumn("__j", F.from_json("line", schema)).select("file", "number", "line", "__j.*")
    text = F.coalesce("ts", "time", "datetime", "date")
    epoch = text.try_cast("double")
    ms = F.when(F.abs(epoch) > 1e11, epoch).otherwise(epoch * 1000)
    words = F.split(F.regexp_replace(text, r"Z$", ""), r"[ T]", 2)
    when = F.coalesce(F.timestamp_millis(ms.cast("long")).cast("timestamp_ntz"), to_utc(parse_naive(words[0], F.coalesce(F.get(words, F.lit(1)), F.lit(""))), zone(tz)))
    bars = _checked(raw.select(
        "file", "number", "line", when.alias("ts"), *PRICES,
        F.coalesce("tick_volume", "tickVolume", F.lit(0.0)).alias("tick_volume"), F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("spread", F.lit(0.0)).alias("spread"),
    ))
    good = bars.filter("error IS NULL").select(F.lit(instrument).alias("instrument"), F.lit(timeframe).alias("timeframe"), "ts", *PRICES, *EXTRAS)
    return BarRead(good, bars.filter("error IS NOT NULL").select("file", "number", "line", "error"))


class BarSource:
    """Where bars come from: :meth:`fetch` gives those of [start, end) in UTC, and the range reaches the scan."""

    def fetch(self, spark: SparkSession, instrument: str, timeframe: str, start: str | None = None, end: str | None = None) -> DataFrame:
        raise NotImplementedError


@dataclass
class FileSource(BarSource):
    """Delimited files."""

    path: str
    tz: str = "UTC"

    def fetch(self, spark, instrument, timeframe, start=None, end=None):
        return read_bars(spark, self.path, instrument, timeframe, self.tz, start, end).good


@dataclass
class TableSource(BarSource):
    """A stored table of bars (Parquet, by instrument and timeframe)."""

    path: str

    def fetch(self, spark, instrument, timeframe, start=None, end=None):
        d = spark.read.schema(BAR_SCHEMA).parquet(self.path).filter((F.col("instrument") == instrument) & (F.col("timeframe") == timeframe))
        if start:
            d = d.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        return d.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz")) if end else d


def write_bars(bars: DataFrame, path: str, tz: str = "UTC") -> None:
    """Tab-separated bars with their header, in the wall time of ``tz``."""
    at = local(F.col("ts"), zone(tz))
    bars.select(
        F.date_format(at, "yyyy.MM.dd").alias("<DATE>"), F.date_format(at, "HH:mm:ss").alias("<TIME>"), F.col("open").alias("<OPEN>"), F.col("high").alias("<HIGH>"), F.col("low").alias("<LOW>"),
        F.col("close").alias("<CLOSE>"), F.col("tick_volume").cast("long").alias("<TICKVOL>"), F.col("volume").cast("long").alias("<VOL>"), F.col("spread").cast("long").alias("<SPREAD>"),
    ).write.mode("overwrite").csv(path, sep="\t", header=True)


@dataclass
class ImportSummary:
    read: int
    accepted: int
    rejected: int
    inserted: int
    duplicates: int
    first: object
    last: object
    file_hash: str
    batch: str | None = None
    repeated: str | None = None  # the finished batch that had the same content


def file_hash(spark: SparkSession, path: str) -> str:
    """A fingerprint of the content at ``path``, whatever its size: sums over all lines of two 64-bit hashes of line and
    line number, per file, and SHA-256 of these in order."""
    lines = numbered_lines(spark, path)
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), "number", "line").cast("decimal(38,0)"))
    each = lines.groupBy("file").agg(F.concat_ws(":", F.count("*"), wide(1), wide(2), F.bit_xor(F.xxhash64(F.lit(3), "number", "line"))).alias("h"))
    return each.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256)).first()[0]


def import_bars(spark: SparkSession, path: str, store: str, instrument: str, timeframe: str = "M1", tz: str = "UTC", start: str | None = None, end: str | None = None, delimiter: str | None = None, catalog=None) -> ImportSummary:
    """Append the bars of a file that the store (Parquet, by instrument and timeframe) lacks. Safe to
    repeat: the first line of a key stays, and a stored bar before any line.

    With a ``catalog`` (see operators.catalog) the import is a batch: content that a finished batch had is recognised
    before a line is parsed and nothing is read; else the batch starts, and it finishes with what was counted. Counts are
    observed in the pass that writes, so rows are parsed once; lines are parsed again only to name errors, if there are any."""
    content = file_hash(spark, path)
    before = catalog.batch_by_hash(content) if catalog else None
    if before:
        return ImportSummary(0, 0, 0, 0, 0, None, None, content, None, before)
    batch = catalog.start_batch(path, content) if catalog else None
    parse = _parser(spark, path, tz, delimiter)
    place = ["__file", "__split", "__line"]  # lines of a split have ascending ids
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__line"), F.col("value").alias("line")
    )
    seen, added = Observation(), Observation()
    good = F.col("error").isNull()
    bars = parse(lines).observe(
        seen, F.count("*").alias("read"), F.count_if(good).alias("accepted"), F.min(F.when(good, F.col("ts"))).alias("first"), F.max(F.when(good, F.col("ts"))).alias("last")
    )
    bars = _in_range(bars.filter(good), start, end).select(F.lit(instrument).alias("instrument"), F.lit(timeframe).alias("timeframe"), "ts", *PRICES, *EXTRAS, *place)
    w = Window.partitionBy(*BAR_KEY).orderBy(*place)
    fresh = bars.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", *place)
    try:
        existing = spark.read.schema(fresh.schema).parquet(store).select(*BAR_KEY)
        fresh = fresh.join(existing, BAR_KEY, "left_anti").select(*fresh.columns)
    except Exception as error:  # no store yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    fresh.observe(added, F.count("*").alias("inserted")).write.mode("append").partitionBy("instrument", "timeframe").parquet(store)
    total, inserted = seen.get, added.get["inserted"]
    rejected = total["read"] - total["accepted"]
    if batch:
        wrong = parse(numbered_lines(spark, path)).filter("error IS NOT NULL").orderBy("file", "number").limit(100).collect() if rejected else []
        catalog.finish_batch(batch, total["accepted"], rejected, [f"{r['number']}: {r['error']}" for r in wrong])
    return ImportSummary(total["read"], total["accepted"], rejected, inserted, total["accepted"] - inserted, total["first"], total["last"], content, batch)
