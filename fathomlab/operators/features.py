"""Point-in-time features. Everything about prices is known at the close of a bar and used at the *next*
row; only the calendar is the entry bar's own. :func:`entry_rows` makes that shift in one place."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import local, parts, session_code
from ..model import Instrument
from ..session import settle
from .bars import daily, running_session
from .indicators import KEYS, highest, lowest, session_vwap, sma, streaks, true_range
from .ordered import by_chunk, carried, moving, placed, sliced
from .scan import recurrences


def ratio(a, b) -> Column:
    """a / b where b is above 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a / F.nullif(b, F.lit(0.0)))


def time_features(ts: Column, ins: Instrument) -> dict[str, Column]:
    p = parts(ts, ins.session_timezone)
    m = p["minute_of_day"]
    return {
        "time_minuteOfDay": m, "time_hour": p["hour"], "time_minute": p["minute"], "time_dayOfWeek": p["day_of_week"], "time_dayOfMonth": p["day_of_month"],
        "time_month": p["month"], "time_year": p["year"], "time_minutesFromOpen": m - ins.open_minute, "time_minutesToClose": ins.close_minute - m,
        "time_session": session_code(m), "time_isRegularSession": ((m >= ins.open_minute) & (m < ins.close_minute)).cast("int"),
    }


@dataclass(frozen=True)
class Bundle:
    """What a feature plugin asks of the one pass over the bars that all plugins share (:func:`together`): windows over at
    most ``back`` earlier bars, exponential averages (name, value, n, alpha), further columns by frames (windows inside a
    session, or carried), windows over these (``late``), and the features, row by row."""

    windows: Mapping[str, Column] = field(default_factory=dict)
    back: int = 0
    averages: tuple[tuple[str, str, int, float], ...] = ()
    frames: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    late: Mapping[str, Column] = field(default_factory=dict)
    late_back: int = 0
    columns: Mapping[str, Column] = field(default_factory=dict)


def by_time():
    """A bar's instrument in time order: for the windows of bundles, which run inside slices."""
    return Window.partitionBy(*KEYS).orderBy("ts")


def together(bars: DataFrame, *bundles: Bundle, entries: bool = False) -> DataFrame:
    """``bars`` with the columns of all bundles, later ones on top of earlier ones: numbered once, cut once into slices that borrow
    the bars next to them (as many as the widest window reaches), and scanned once for all averages. With ``entries`` also
    the bar that follows each: entry_ts and entry_open."""
    d = placed(bars, KEYS)
    merged = lambda part: {k: c for b in bundles for k, c in getattr(b, part).items()}
    if windows := merged("windows"):
        d = moving(d, max(b.back for b in bundles), lambda x: x.withColumns(windows))
    averages = list(dict.fromkeys(a for b in bundles for a in b.averages))
    d = recurrences(d, averages, KEYS) if averages else settle(d)
    for frame in dict.fromkeys(f for b in bundles for f in b.frames):
        d = frame(d)
    late = merged("late") | ({f"entry_{c}": F.lead(c).over(by_time()) for c in ("ts", "open")} if entries else {})
    if late:
        d = moving(d, max(b.late_back for b in bundles) if bundles else 0, lambda x: x.withColumns(late), ahead=1 if entries else 0)
    for b in bundles:
        for name, column in b.columns.items():
            d = d.withColumn(name, column)
    return d


def _shown(d: DataFrame, *hidden: str) -> DataFrame:
    return d.drop("__at", "__chunk", *hidden)


def candle() -> Bundle:
    """Anatomy of the closed bar; ratios are null without a range."""
    size, body = F.col("high") - F.col("low"), F.abs(F.col("close") - F.col("open"))
    upper, lower = F.col("high") - F.greatest("open", "close"), F.least("open", "close") - F.col("low")
    return Bundle({"candle_avgRange5": F.avg(size).over(by_time().rowsBetween(-4, 0))}, 4, frames=(streaks,), columns={
        "candle_range": size, "candle_body": body, "candle_upperWick": upper, "candle_lowerWick": lower, "candle_bodyRatio": ratio(body, size), "candle_upperWickRatio": ratio(upper, size),
        "candle_lowerWickRatio": ratio(lower, size), "candle_isBullish": (F.col("close") > F.col("open")).cast("int"), "candle_consecutiveBullish": F.col("consecutive_bullish").cast("int"),
        "candle_consecutiveBearish": F.col("consecutive_bearish").cast("int"),
    })


def volatility(fast: int = 14, slow: int = 50) -> Bundle:
    """Average true ranges, their ratio, and the spans of the last bars."""
    ranges = {f"volatility_range{n}": highest(n) - lowest(n) for n in (5, 15, 60)}
    return Bundle(
        {"__tr": true_range(), **ranges}, 59, (("volatility_atr", "__tr", fast, 1 / fast), ("volatility_atrSlow", "__tr", slow, 1 / slow)),
        columns={"volatility_atrRegime": ratio("volatility_atr", "volatility_atrSlow"), "volatility_atrPercent": ratio(F.col("volatility_atr") * 10000, "close")},
    )


def trend(lag: int = 10) -> Bundle:
    """Needs volatility_atr. Alignment is 1 or -1 if the three averages are in order, 0 if not."""
    periods = (20, 50, 200)
    mean = {n: F.col(f"trend_ema{n}") for n in periods}
    a, b, c = mean.values()
    return Bundle(
        averages=tuple((f"trend_ema{n}", "close", n, 2 / (n + 1)) for n in periods), late={f"__was{n}": F.lag(f"trend_ema{n}", lag).over(by_time()) for n in periods}, late_back=lag,
        columns={f"trend_slopeEma{n}": ratio((mean[n] - F.col(f"__was{n}")) / lag, "volatility_atr") for n in periods}
        | {f"trend_distanceEma{n}Atr": ratio(F.col("close") - mean[n], "volatility_atr") for n in (20, 200)}
        | {"trend_alignment": F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), F.when((a > b) & (b > c), 1).when((a < b) & (b < c), -1).otherwise(0))},
    )


def vwap(tz: str) -> Bundle:
    """Distance from the session's volume-weighted price; needs volatility_atr."""
    return Bundle(frames=(lambda d: session_vwap(d, tz, "vwap_value"),), columns={
        "vwap_distance": F.col("close") - F.col("vwap_value"), "vwap_distanceAtr": ratio("vwap_distance", "volatility_atr"), "vwap_side": F.signum("vwap_distance")
    })


def market(tz: str) -> Bundle:
    """Of the running session and the one before; needs volatility_atr."""

    def sessions(d: DataFrame) -> DataFrame:
        before = daily(d, tz).select("instrument", "session_date", "prev_high", "prev_low", "prev_close")
        return running_session(d, tz).join(before, ["instrument", "session_date"], "left")

    span, opened = F.col("prev_high") - F.col("prev_low"), F.col("today_open")
    return Bundle({"__volume60": sma("tick_volume", 60)}, 59, frames=(sessions,), columns={
        "market_dailyOpen": opened, "market_gapPoints": opened - F.col("prev_close"), "market_gapAtr": ratio(opened - F.col("prev_close"), "volatility_atr"),
        "market_distanceToOpenAtr": ratio(F.col("close") - opened, "volatility_atr"), "market_prevDayHigh": F.col("prev_high"), "market_prevDayLow": F.col("prev_low"),
        "market_prevDayClose": F.col("prev_close"), "market_prevDayRange": span, "market_distanceToPrevHighAtr": ratio(F.col("close") - F.col("prev_high"), "volatility_atr"),
        "market_distanceToPrevLowAtr": ratio(F.col("close") - F.col("prev_low"), "volatility_atr"), "market_dayRangeUsed": ratio(F.col("today_high") - F.col("today_low"), span),
        "market_volume": F.col("tick_volume"), "market_relativeVolume": ratio("tick_volume", "__volume60"),
    })


def opening(tz: str, open_minute: int, range_minutes: int = 15) -> Bundle:
    """Of the opening range of a session: what :func:`opening_session` follows, in average true ranges; all null before the open.
    Needs volatility_atr."""
    opened, mid = F.col("open_price").isNotNull(), (F.col("range_high") + F.col("range_low")) / 2
    said = {
        "minutesSinceOpen": F.col("m") - F.col("open_minute"), "openingRangeHigh": F.col("range_high"), "openingRangeLow": F.col("range_low"),
        "openingRangeSizeAtr": ratio(F.col("range_high") - F.col("range_low"), "volatility_atr"), "openingRangeComplete": F.col("complete").cast("int"), "impulseDirection": F.col("impulse"),
        "impulseSizeAtr": ratio("impulse_size", "volatility_atr"), "breakoutSide": F.col("breakout_side"), "minutesSinceBreakout": F.col("m") - F.col("breakout_minute"),
        "excursionWithImpulseAtr": ratio("excursion_with", "volatility_atr"), "excursionAgainstImpulseAtr": ratio("excursion_against", "volatility_atr"),
        "pullbackFromExtremeAtr": ratio("pullback", "volatility_atr"), "pullbackFraction": F.col("pullback_fraction"), "crossedBackOpen": F.col("cross_minute").isNotNull().cast("int"),
        "minutesToOpenCross": F.col("minutes_to_cross"), "distanceToRangeMidAtr": ratio(F.col("close") - mid, "volatility_atr"),
    }
    return Bundle(frames=(lambda d: opening_session(d, tz, open_minute, range_minutes),), columns={f"nas100_{k}": F.when(opened, c) for k, c in said.items()})


def candle_features(bars: DataFrame) -> DataFrame:
    return _shown(together(bars, candle()))


def volatility_features(bars: DataFrame, fast: int = 14, slow: int = 50) -> DataFrame:
    return _shown(together(bars, volatility(fast, slow)), "__tr")


def market_features(bars: DataFrame, tz: str) -> DataFrame:
    """``bars`` have volatility_atr."""
    return _shown(together(bars, market(tz)), "__volume60")


def opening_session(bars: DataFrame, tz: str, open_minute: int, range_minutes: int, minute: Column | None = None, date: Column | None = None) -> DataFrame:
    """The state of the opening range after each bar: range, impulse, breakout, crossing back, extremes
    and pullback. ``minute`` and ``date`` are of the bar's open unless given (entry rules take the close)."""
    at = local(F.col("ts"), tz)
    d = bars.withColumn("session", date if date is not None else at.cast("date")).withColumn("m", minute if minute is not None else F.hour(at) * 60 + F.minute(at))
    live = F.col("m") >= open_minute
    w = Window.partitionBy("instrument", "session").orderBy("ts")
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("instrument", "session")
    d = d.withColumn("open_minute", F.min(F.when(live, F.col("m"))).over(up)).withColumn("open_price", F.first(F.when(live, F.col("open")), ignorenulls=True).over(up))
    d = d.withColumn("done_at", F.min(F.when(live & (F.col("m") - F.col("open_minute") >= range_minutes - 1), F.col("m"))).over(whole))
    inside = live & (F.col("done_at").isNull() | (F.col("m") <= F.col("done_at")))
    complete = F.coalesce(F.col("m") >= F.col("done_at"), F.lit(False)) & live
    d = d.withColumn("range_high", F.max(F.when(inside, F.col("high"))).over(up)).withColumn("range_low", F.min(F.when(inside, F.col("low"))).over(up)).withColumn("complete", complete)
    d = d.withColumn("impulse_close", F.first(F.when(F.col("complete"), F.col("close")), ignorenulls=True).over(up))
    d = d.withColumn("impulse", F.signum(F.col("impulse_close") - F.col("open_price"))).withColumn("impulse_size", F.abs(F.col("impulse_close") - F.col("open_price")))
    d = d.withColumn("session_high", F.max(F.when(live, F.col("high"))).over(up)).withColumn("session_low", F.min(F.when(live, F.col("low"))).over(up))
    side = F.when(F.col("complete"), F.when(F.col("close") > F.col("range_high"), 1).when(F.col("close") < F.col("range_low"), -1))
    d = d.withColumn("breakout_minute", F.min(F.when(side.isNotNull(), F.col("m"))).over(up)).withColumn("breakout_side", F.coalesce(F.first(side, ignorenulls=True).over(up), F.lit(0)))
    crossed = F.col("complete") & (((F.col("impulse") > 0) & (F.col("low") <= F.col("open_price"))) | ((F.col("impulse") < 0) & (F.col("high") >= F.col("open_price"))))
    d = d.withColumn("cross_minute", F.min(F.when(crossed, F.col("m"))).over(up))
    with_ = F.when(F.col("impulse") >= 0, F.col("session_high") - F.col("open_price")).otherwise(F.col("open_price") - F.col("session_low"))
    against = F.when(F.col("impulse") >= 0, F.col("open_price") - F.col("session_low")).otherwise(F.col("session_high") - F.col("open_price"))
    back = F.when(F.col("impulse") >= 0, F.col("session_high") - F.col("close")).otherwise(F.col("close") - F.col("session_low"))
    known = F.col("impulse").isNotNull()
    d = d.withColumn("excursion_with", F.when(known, with_)).withColumn("excursion_against", F.when(known, against)).withColumn("pullback", F.when(known, back))
    return d.withColumn("pullback_fraction", ratio("pullback", "excursion_with")).withColumn("minutes_to_cross", F.col("cross_minute") - F.col("open_minute"))


def entry_rows(features: DataFrame) -> DataFrame:
    """Each closed bar with the bar that follows it: entry_ts and entry_open (null after the last)."""
    return moving(features, 0, lambda d: d.withColumns({f"entry_{c}": F.lead(c).over(by_time()) for c in ("ts", "open")}), ahead=1)


def asof_previous(primary: DataFrame, other: DataFrame, columns: list[str], visible: str = "visible_from") -> DataFrame:
    """Columns of the last row of ``other`` that is visible at each primary bar: stacked and filled
    forward inside slices of time, what a slice ends with carried to the next, without a range join."""
    a = primary.select("instrument", F.col("ts").alias("__t"), F.lit(1).alias("__kind"), "ts", *(F.lit(None).cast(other.schema[c].dataType).alias(c) for c in columns))
    b = other.select("instrument", F.col(visible).alias("__t"), F.lit(0).alias("__kind"), F.lit(None).cast("timestamp_ntz").alias("ts"), *columns)
    d = sliced(a.unionByName(b), "__t")
    up = by_chunk(["instrument"], ["__t", "__kind"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = {c: F.when(F.col(c).isNotNull(), F.struct("__t", "__kind", c)) for c in columns}
    d = d.select("*", *(F.last(x, ignorenulls=True).over(up).alias(f"__in_{c}") for c, x in seen.items()))
    d = carried(d, ["instrument"], **{f"__was_{c}": (F.max(x), "max", F.lit(None)) for c, x in seen.items()})
    return d.filter("__kind = 1").select("instrument", "ts", *(F.coalesce(f"__in_{c}", f"__was_{c}")[c].alias(c) for c in columns))
