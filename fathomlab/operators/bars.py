"""Bars: resampling, sessions, gaps, coverage, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import local
from ..model import TIMEFRAMES


def _ohlcv() -> list:
    return [
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("tick_volume").alias("tick_volume"), F.sum("volume").alias("volume"), F.max_by("spread", "ts").alias("spread"), F.count("*").alias("bar_count"),
    ]


def resample(bars: DataFrame, timeframe: str, tz: str = "America/New_York", closed_only: bool = False) -> DataFrame:
    """Bars of a longer timeframe: aligned to the epoch in UTC; D1 by market date, stamped with its first
    bar. ``closed_only`` leaves out each instrument's last, still open one. Aggregates combine map-side."""
    minutes = TIMEFRAMES[timeframe]
    if timeframe == "D1":
        out = bars.groupBy("instrument", local(F.col("ts"), tz).cast("date").alias("__d")).agg(F.min("ts").alias("__ts"), *_ohlcv())
        out = out.withColumn("ts", F.col("__ts")).drop("__d", "__ts")
    else:
        epoch = F.unix_micros(F.col("ts").cast("timestamp"))
        width = minutes * 60_000_000
        start = F.timestamp_micros(epoch - F.pmod(epoch, F.lit(width))).cast("timestamp_ntz")
        out = bars.groupBy("instrument", start.alias("ts_bucket")).agg(*_ohlcv()).withColumnRenamed("ts_bucket", "ts")
    if closed_only:
        last = out.groupBy("instrument").agg(F.max("ts").alias("__last"))
        out = out.join(last, "instrument").filter("ts < __last").drop("__last")
    return out.select("instrument", "ts", "open", "high", "low", "close", "tick_volume", "volume", "spread", "bar_count")


def daily(bars: DataFrame, tz: str = "America/New_York") -> DataFrame:
    """One row per market session, and the same of the session before."""
    d = bars.withColumn("session_date", local(F.col("ts"), tz).cast("date")).groupBy("instrument", "session_date").agg(*_ohlcv())
    w = Window.partitionBy("instrument").orderBy("session_date")  # one row per day and instrument
    return d.select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in ("session_date", "open", "high", "low", "close", "tick_volume")))


def running_session(bars: DataFrame, tz: str = "America/New_York") -> DataFrame:
    """Each bar with its session so far: open, high, low, close, volume and count, up to and with it."""
    d = bars.withColumn("session_date", local(F.col("ts"), tz).cast("date"))
    w = Window.partitionBy("instrument", "session_date").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.select("*", F.first("open").over(w).alias("today_open"), F.max("high").over(w).alias("today_high"), F.min("low").over(w).alias("today_low"), F.sum("tick_volume").over(w).alias("today_volume"), F.count("*").over(w).alias("today_bars"))


def gaps(bars: DataFrame, max_minutes: float) -> DataFrame:
    """Pauses longer than ``max_minutes`` between consecutive bars. Windows run per instrument and day;
    a day's last bar is carried into the next by a join of one row per day."""
    d = bars.select("instrument", "ts", F.to_date("ts").alias("__d"))
    w = Window.partitionBy("instrument", "__d").orderBy("ts")
    d = d.withColumn("__prev", F.lag("ts").over(w))
    last = d.groupBy("instrument", "__d").agg(F.max("ts").alias("__end"))
    last = last.select("instrument", "__d", F.lag("__end").over(Window.partitionBy("instrument").orderBy("__d")).alias("__before"))
    d = d.join(last, ["instrument", "__d"]).withColumn("from_ts", F.coalesce("__prev", "__before"))
    minutes = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("from_ts").cast("timestamp"))) / 60e6
    return d.select("instrument", "from_ts", F.col("ts").alias("to_ts"), minutes.alias("minutes")).filter(F.col("minutes") > max_minutes)


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("instrument").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def minute_profile(bars: DataFrame, tz: str = "America/New_York", top: int = 8, open_minute: int = 570) -> DataFrame:
    """The market minutes with most volume, and their distance from the open: a check of time zones."""
    at = local(F.col("ts"), tz)
    minute = F.hour(at) * 60 + F.minute(at)
    p = bars.groupBy("instrument", minute.alias("minute")).agg(F.count("*").alias("n"), F.sum("tick_volume").alias("tick_volume"))
    w = Window.partitionBy("instrument").orderBy(F.col("tick_volume").desc(), F.col("minute").asc())
    return p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).withColumn("distance", F.abs(F.col("minute") - open_minute))


def closed_by(bars: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Only bars that are complete at ``now``: those whose end is not later."""
    return bars.filter(F.col("ts") + F.make_dt_interval(mins=F.lit(minutes)) <= now)


def require_complete(bars: DataFrame, now: Column, minutes: int) -> DataFrame:
    """``bars`` as they are, but a bar that is not complete at ``now`` ends the query with an error."""
    early = F.col("ts") + F.make_dt_interval(mins=F.lit(minutes)) > now
    return bars.withColumn("ts", F.when(early, F.raise_error(F.concat(F.lit("E_LOOKAHEAD: a bar ends after "), now.cast("string"))).cast("timestamp_ntz")).otherwise(F.col("ts")))
