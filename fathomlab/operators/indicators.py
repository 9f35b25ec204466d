"""Indicators over bars, per instrument and in time order.

Moving windows are window functions, to be run by ``ordered.moving`` so that one long series is not one task; exponential
recurrences are scanned (``operators.scan``). All are null until they have seen enough bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import local
from ..session import settle
from .ordered import by_chunk, carried, matched, moving, placed, sliced
from .scan import recurrences

KEYS = ["instrument"]


def _series():
    return Window.partitionBy(*KEYS).orderBy("ts")


def sma(value: str, n: int) -> Column:
    w = _series().rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) >= n, F.avg(value).over(w))


def true_range() -> Column:
    prev = F.lag("close").over(_series())
    span = F.col("high") - F.col("low")
    return F.when(prev.isNull(), span).otherwise(F.greatest(span, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def highest(n: int) -> Column:
    return F.max("high").over(_series().rowsBetween(-(n - 1), 0))


def lowest(n: int) -> Column:
    return F.min("low").over(_series().rowsBetween(-(n - 1), 0))


def session_vwap(bars: DataFrame, tz: str, name: str = "vwap") -> DataFrame:
    """Volume-weighted typical price since the session began; a bar without volume weighs 1."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    weight = F.when(F.col("tick_volume") > 0, F.col("tick_volume")).otherwise(1.0)
    w = Window.partitionBy(*KEYS, local(F.col("ts"), tz).cast("date")).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bars.withColumn(name, F.sum(typical * weight).over(w) / F.sum(weight).over(w))


def streaks(bars: DataFrame) -> DataFrame:
    """Consecutive bullish and bearish bars up to and with each bar; a bar without body ends both. The
    count is the distance from the last bar of another sign."""
    d = bars if "__at" in bars.columns else settle(placed(bars, KEYS))
    sign = F.signum(F.col("close") - F.col("open"))
    sides = {"consecutive_bullish": 1, "consecutive_bearish": -1}
    d = d.withColumns({f"__other{s}": F.when(sign != s, F.col("__at")) for s in sides.values()})
    up = by_chunk(KEYS, ["ts"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = d.withColumns({f"__here{s}": F.max(f"__other{s}").over(up) for s in sides.values()})
    d = carried(here, KEYS, **{f"__last{s}": (F.max(f"__other{s}"), "max", F.lit(0)) for s in sides.values()})
    d = d.withColumns({name: F.col("__at") - F.coalesce(F.col(f"__here{s}"), F.col(f"__last{s}")) for name, s in sides.items()})
    return d.select(*bars.columns, *sides)


def ema(df: DataFrame, n: int, value: str = "close", name: str | None = None) -> DataFrame:
    """Seeded with the simple mean of the first n values; weight 2 / (n + 1)."""
    return recurrences(df, [(name or f"ema{n}", value, n, 2 / (n + 1))], KEYS)


def atr(df: DataFrame, n: int, name: str | None = None) -> DataFrame:
    """Wilder's average true range: weight 1 / n."""
    ranged = moving(placed(df, KEYS), 1, lambda d: d.withColumn("__tr", true_range()))
    return recurrences(ranged, [(name or f"atr{n}", "__tr", n, 1 / n)], KEYS).drop("__tr", "__at", "__chunk")


def buffered(bars: DataFrame, value: str, size: int) -> DataFrame:
    """``bars`` with ``buffer``: the last ``size`` values up to this bar, oldest first."""
    w = Window.partitionBy(*KEYS).orderBy("ts").rowsBetween(1 - size, Window.currentRow)
    return bars.withColumn("buffer", F.collect_list(F.struct("ts", value)).over(w)).withColumn("buffer", F.transform(F.sort_array("buffer"), lambda x: x[value]))


def back(buffer: str, n: int) -> Column:
    """The value ``n`` bars back (0: this bar), null while there are not so many."""
    return F.when(F.size(buffer) > n, F.element_at(buffer, -1 - n))


def running_stats(bars: DataFrame, value: str) -> DataFrame:
    """``bars`` with ``running_n``, ``running_sum`` and ``running_sd`` (null for one value) of all values so far.
    Sums are of differences from the instrument's mean, inside slices, and carried from slice to slice."""
    centre = bars.groupBy(*KEYS).agg(F.avg(value).alias("__c"))
    d = matched(sliced(bars, "ts"), centre, KEYS).withColumn("__x", F.col(value) - F.col("__c"))
    up = by_chunk(KEYS, ["ts"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__k", F.count("__x").over(up)).withColumn("__s", F.sum("__x").over(up)).withColumn("__q", F.sum(F.col("__x") * F.col("__x")).over(up))
    zero = F.lit(0.0)
    d = carried(d, KEYS, __bk=(F.count("__x"), "sum", F.lit(0)), __bs=(F.sum("__x"), "sum", zero), __bq=(F.sum(F.col("__x") * F.col("__x")), "sum", zero))
    n, s, q = F.col("__bk") + F.col("__k"), F.col("__bs") + F.col("__s"), F.col("__bq") + F.col("__q")
    sd = F.when(n > 1, F.sqrt(F.greatest(zero, q - s * s / n) / F.nullif(n - 1, F.lit(0))))
    return d.select(*bars.columns, n.alias("running_n"), (s + n * F.col("__c")).alias("running_sum"), sd.alias("running_sd"))
