"""Entry rules: bars in, signals out (instrument, ts of the bar that closed, direction, targets). A rule
sees the calendar of the bar's *close*; its entry is the next bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import local
from .features import opening_session
from .indicators import KEYS, true_range
from .ordered import moving

SIGNAL = ["instrument", "ts", "direction", "take_profit", "stop_loss", "max_hold", "rule_id"]


def closed(bars: DataFrame, minutes: int, tz: str) -> DataFrame:
    """Bars with the calendar of their close: close_date, close_minute, close_dow."""
    at = local(F.col("ts") + F.make_dt_interval(mins=F.lit(minutes)), tz)
    return bars.withColumn("close_date", at.cast("date")).withColumn("close_minute", F.hour(at) * 60 + F.minute(at)).withColumn("close_dow", F.weekday(at) + 1)


def _signals(d: DataFrame, direction: Column, tp: float, sl: float, hold: int, rule: str) -> DataFrame:
    return d.select("instrument", "ts", direction.alias("direction"), F.lit(float(tp)).alias("take_profit"), F.lit(float(sl)).alias("stop_loss"), F.lit(float(hold)).alias("max_hold"), F.lit(rule).alias("rule_id"))


def _both(which: str) -> Column:
    return F.explode(F.array(*(F.lit(x) for x in (("long", "short") if which == "both" else (which,)))))


def time_of_day(c: DataFrame, minute: int = 570, which: str = "both", days: tuple[int, ...] = (1, 2, 3, 4, 5), tp: float = 40, sl: float = 40, hold: int = 120) -> DataFrame:
    return _signals(c.filter((F.col("close_minute") == minute) & F.col("close_dow").isin(*days)), _both(which), tp, sl, hold, "time-of-day")


def scalp_sampler(c: DataFrame, interval: int = 15, start: int = 570, end: int = 960, which: str = "both", tp: float = 20, sl: float = 20, hold: int = 30) -> DataFrame:
    m = F.col("close_minute")
    return _signals(c.filter((m >= start) & (m <= end) & ((m - start) % interval == 0)), _both(which), tp, sl, hold, "scalp-sampler")


def _first_per_session(d: DataFrame) -> DataFrame:
    w = Window.partitionBy("instrument", "close_date").orderBy("ts")
    return d.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def opening_range_breakout(c: DataFrame, minutes: int = 15, open_minute: int = 570, last: int = 780, tp: float = 60, sl: float = 30, hold: int = 180, fade: bool = False) -> DataFrame:
    """The range takes bars from the open through the first that closes at open + minutes or later; then
    the first close outside it, once per session."""
    day = Window.partitionBy("instrument", "close_date")
    m = F.col("close_minute")
    d = c.filter(m >= open_minute).withColumn("__done", F.min(F.when(m >= open_minute + minutes, m)).over(day))
    inside = m <= F.col("__done")
    d = d.withColumn("__high", F.max(F.when(inside, F.col("high"))).over(day)).withColumn("__low", F.min(F.when(inside, F.col("low"))).over(day))
    hit = d.filter((m > F.col("__done")) & (m <= last) & ((F.col("close") > F.col("__high")) | (F.col("close") < F.col("__low"))))
    up = F.col("close") > F.col("__high")
    direction = F.when(up if not fade else ~up, "long").otherwise("short")
    return _signals(_first_per_session(hit), direction, tp, sl, hold, "opening-range-breakout")


def range_fade(c: DataFrame, start: int = 180, end: int = 480, last: int = 1439, tp: float = 60, sl: float = 30, hold: int = 240) -> DataFrame:
    """The first touch of the morning range after it ended, against its direction; high before low."""
    day = Window.partitionBy("instrument", "close_date")
    m = F.col("close_minute")
    inside = (m >= start) & (m < end)
    d = c.withColumn("__high", F.max(F.when(inside, F.col("high"))).over(day)).withColumn("__low", F.min(F.when(inside, F.col("low"))).over(day))
    hit = d.filter((m >= end) & (m <= last) & ((F.col("high") >= F.col("__high")) | (F.col("low") <= F.col("__low"))))
    return _signals(_first_per_session(hit), F.when(F.col("high") >= F.col("__high"), "short").otherwise("long"), tp, sl, hold, "range-fade")


def opening_reversal(c: DataFrame, tz: str, minutes: int = 15, open_minute: int = 570, atr_period: int = 14, min_impulse: float = 0.5, pullback: tuple[float, float] = (0.5, 1.5), last: int = 780, tp: float = 50, sl: float = 25, hold: int = 180) -> DataFrame:
    """Fades the opening impulse once a pullback confirms it; the true range is a plain mean over the
    last bars that have a predecessor."""
    n = max(2, atr_period)
    series = Window.partitionBy(*KEYS).orderBy("ts")
    ranges = {"__tr": F.when(F.lag("close").over(series).isNotNull(), true_range())}
    d = moving(c, n, lambda x: x.withColumns(ranges).withColumn("__atr", F.avg("__tr").over(series.rowsBetween(1 - n, 0))))
    d = opening_session(d, tz, open_minute, minutes, F.col("close_minute"), F.col("close_date"))
    hit = d.filter(
        F.col("complete") & (F.col("close_minute") <= last) & (F.col("impulse") != 0) & (F.col("__atr") > 0) & (F.col("impulse_size") >= min_impulse * F.col("__atr"))
        & (F.col("pullback_fraction") >= pullback[0]) & (F.col("pullback_fraction") < pullback[1])
    )
    return _signals(_first_per_session(hit), F.when(F.col("impulse") > 0, "short").otherwise("long"), tp, sl, hold, "opening-reversal")


LEVELS = ("pp", "r1", "s1", "r2", "s2", "r3", "s3")


def pivot_scalp(c: DataFrame, daily: DataFrame, tolerance: float = 8, cooldown: int = 20, start: int = 570, end: int = 960, levels: tuple[str, ...] = LEVELS, tp: float = 15, sl: float = 15, hold: int = 45) -> DataFrame:
    """Touches of the previous session's pivot levels, each level at most once per cooldown. The greedy
    cooldown is a fold over the touches of one session and level."""
    h, lo, cl = F.col("prev_high"), F.col("prev_low"), F.col("prev_close")
    pp = (h + lo + cl) / 3
    value = {"pp": pp, "r1": 2 * pp - lo, "s1": 2 * pp - h, "r2": pp + (h - lo), "s2": pp - (h - lo), "r3": h + 2 * (pp - lo), "s3": lo - 2 * (h - pp)}
    pivots = daily.filter("prev_close IS NOT NULL").select("instrument", F.col("session_date").alias("close_date"), F.explode(F.array(*(F.struct(F.lit(k).alias("level"), value[k].alias("price")) for k in levels))).alias("p")).select("instrument", "close_date", "p.level", "p.price")
    m = F.col("close_minute")
    touch = c.filter((m >= start) & (m <= end)).join(pivots, ["instrument", "close_date"]).filter(F.abs(F.col("close") - F.col("price")) <= tolerance)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    lists = touch.groupBy("instrument", "close_date", "level").agg(F.sort_array(F.collect_list(F.struct(micros.alias("t"), F.col("ts").alias("ts"), (F.col("open") > F.col("price")).alias("above")))).alias("x"))
    empty = F.struct(F.filter("x", lambda y: F.lit(False)).alias("out"), F.lit(-(2**62)).alias("last"))
    kept = F.aggregate("x", empty, lambda a, y: F.when(y["t"] - a["last"] >= cooldown * 60_000_000, F.struct(F.concat(a["out"], F.array(y)).alias("out"), y["t"].alias("last"))).otherwise(a))
    d = lists.select("instrument", "level", F.explode(kept["out"]).alias("s")).select("instrument", "level", F.col("s.ts").alias("ts"), "s.above")
    return _signals(d, F.when(F.col("above"), "long").otherwise("short"), tp, sl, hold, "pivot-scalp")
