"""Path simulation: what becomes of a signal over the bars that follow.

A position opens at the next bar's open and is evaluated on that bar already. Per bar the stop comes
before the target, the target before the time limit; what is still open at the last bar closes there.

Where a position ends is found without reading the bars between: bars are grouped by place into blocks of WIDTH, blocks
into blocks of blocks, each with its lowest low and highest high. A position looks through the rest of its own block, the rest of
the blocks beside that, and so on up; where something touches stop or target, it looks into that block, down to the bar. That
is an equi-join with at most WIDTH rows a level, however long the position may be held. Then positions meet the bars
that they did hold, by an equi-join on (instrument, day), so the work spreads over days; folds run per position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..model import Instrument
from ..session import settle
from .indicators import KEYS
from .ordered import moving, next_at, placed

SPREAD, SLIPPAGE, COMMISSION, PULLBACK = 1.0, 0.5, 0.0, 0.35
#: Instruments whose last bars are broadcast.
SMALL = 100_000
OUTCOMES = ["exit_ts", "exit_price", "exit_reason", "minutes", "pnl_points", "pnl_money", "mae", "mfe", "minutes_to_mae", "minutes_to_mfe", "max_speed", "slope", "pullbacks", "efficiency"]


#: Places of a block are 2 to the power of BITS.
BITS = 6


def numbered(bars: DataFrame) -> DataFrame:
    """Bars with their place (``__at``, from 1) and the bar that follows, settled."""
    own = placed(bars.select(*KEYS, "ts", "open", "high", "low", "close"), KEYS)
    w = Window.partitionBy(*KEYS).orderBy("ts")
    return settle(moving(own, 0, lambda d: d.withColumns({f"entry_{c}": F.lead(c).over(w) for c in ("ts", "open")}), ahead=1).drop("__chunk"))


def positions(signals: DataFrame, bars: DataFrame, spread: float = SPREAD, slippage: float = SLIPPAGE) -> DataFrame:
    """Signals with the following bar's open, costs, and target and stop prices. A signal on the last bar
    opens nothing. ``bars``: what :func:`numbered` gives, or plain bars."""
    bars = bars if "__at" in bars.columns else numbered(bars)
    nxt = bars.select(*KEYS, "ts", "entry_ts", "entry_open", (F.col("__at") + 1).alias("entry_at"))
    sign = F.when(F.col("direction") == "long", 1).otherwise(-1)
    own = signals.drop("entry_ts", "entry_open", "entry_at")
    d = own.join(nxt, [*KEYS, "ts"]).filter("entry_ts IS NOT NULL").withColumn("sign", sign)
    d = d.withColumn("entry_price", F.col("entry_open") + F.col("sign") * F.lit(spread / 2 + slippage))
    d = d.withColumn("target", F.col("entry_price") + F.col("sign") * F.col("take_profit")).withColumn("stop", F.col("entry_price") - F.col("sign") * F.col("stop_loss"))
    seq = F.row_number().over(Window.partitionBy(*KEYS, "entry_ts").orderBy("rule_id", "direction", "ts"))
    return d.withColumn("trade_id", F.concat_ws("_", F.col("instrument"), F.col("rule_id"), F.date_format("entry_ts", "yyyyMMddHHmmss"), F.col("direction"), seq))


def first_touch(p: DataFrame, bars: DataFrame) -> DataFrame:
    """trade_id, hit_at: the place of the first bar at or after ``entry_at`` with a low at or under ``under`` or a high at or over
    ``over``; positions (trade_id, instrument, entry_at, under, over) that nothing touches are left out. ``bars``: settled, with
    their place."""
    longest = bars.agg(F.max("__at")).first()[0] or 1
    top = max(1, (longest.bit_length() + BITS - 1) // BITS)
    level = [bars.select("instrument", (F.col("__at") - 1).alias("place"), "low", "high")]
    for _ in range(top):
        wider = level[-1].groupBy("instrument", F.shiftright("place", BITS).alias("place")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        level.append(settle(wider) if len(level) == 1 else wider)
    inside = [d.withColumn("block", F.shiftright("place", BITS)) for d in level]
    touches = (F.col("low") <= F.col("under")) | (F.col("high") >= F.col("over"))
    asked = p.select("trade_id", "instrument", "under", "over", (F.col("entry_at") - 1).alias("from"))

    def rest(k: int) -> DataFrame:
        """Of the block that holds a position's begin, what lies behind it on level ``k``; the begin itself on level 0 alone."""
        own = asked.withColumn("own", F.shiftright("from", BITS * k)).withColumn("block", F.shiftright("own", BITS))
        ahead = (F.col("place") >= F.col("own")) if k == 0 else (F.col("place") > F.col("own"))
        return own.join(inside[k], ["instrument", "block"]).filter(ahead & touches).select("trade_id", F.struct(F.lit(k).alias("level"), "place").alias("hit"))

    found = reduce(DataFrame.union, (rest(k) for k in range(top + 1))).groupBy("trade_id").agg(F.min("hit").alias("hit"))
    found = settle(found.join(asked, "trade_id").select("trade_id", "instrument", "under", "over", "hit.level", "hit.place"))
    for k in range(top, 0, -1):
        into = found.filter(F.col("level") == k).withColumnRenamed("place", "block").drop("level").join(inside[k - 1], ["instrument", "block"]).filter(touches)
        into = into.groupBy("trade_id", "instrument", "under", "over").agg(F.min("place").alias("place")).withColumn("level", F.lit(k - 1))
        found = found.filter(F.col("level") < k).unionByName(into)
    return found.select("trade_id", (F.col("place") + 1).alias("hit_at"))


def exits(p: DataFrame, bars: DataFrame) -> DataFrame:
    """Positions with ``exit_ts`` and ``exit_reason``. ``bars``: settled, with their place."""
    due = p.withColumn("due", F.col("entry_ts") + F.make_dt_interval(mins=F.col("max_hold").cast("int")))  # gaps postpone the limit
    due = settle(next_at(due, bars.select("instrument", "ts"), "instrument", "due", "ts", "limit_ts").drop("due"))
    long = F.col("sign") == 1
    levels = due.withColumn("under", F.when(long, F.col("stop")).otherwise(F.col("target"))).withColumn("over", F.when(long, F.col("target")).otherwise(F.col("stop")))
    hit = first_touch(levels, bars)
    at = bars.select("instrument", F.col("__at").alias("hit_at"), F.col("ts").alias("hit_ts"), F.col("low").alias("hit_low"), F.col("high").alias("hit_high"))
    last = bars.groupBy("instrument").agg(F.max("ts").alias("last_ts"))
    d = due.join(hit, "trade_id", "left").join(at, ["instrument", "hit_at"], "left").join(F.broadcast(last) if last.count() <= SMALL else last, "instrument")
    until = F.coalesce("limit_ts", "last_ts")
    stopped = F.when(long, F.col("hit_low") <= F.col("stop")).otherwise(F.col("hit_high") >= F.col("stop"))
    early = F.col("hit_ts").isNotNull() & (F.col("hit_ts") <= until)
    reason = F.when(early & stopped, "stop_loss").when(early, "take_profit").when(F.col("limit_ts").isNotNull(), "time_limit").otherwise("session_end")
    return d.withColumn("exit_reason", reason).withColumn("exit_ts", F.when(early, F.col("hit_ts")).otherwise(until)).drop("hit_at", "hit_ts", "hit_low", "hit_high", "last_ts", "limit_ts")


def simulate(signals: DataFrame, bars: DataFrame, instrument: Instrument | None = None, spread: float = SPREAD, slippage: float = SLIPPAGE, commission: float = COMMISSION, lots: float = 1.0, kept: list[str] | None = None) -> DataFrame:
    """One row per position: entry, exit and the OUTCOMES of its path, and the signals' columns ``kept``. Money is points
    times the point's value times ``lots``, less the commission."""
    value, kept = (instrument.point_value if instrument else 1.0), kept or []
    own = numbered(bars)
    p = settle(exits(positions(signals, own, spread, slippage), own))
    days = p.drop(*kept).withColumn("__day", F.explode(F.sequence(F.to_date("entry_ts"), F.to_date("exit_ts"))))
    b = own.select("instrument", F.col("ts").alias("bar_ts"), F.to_date("ts").alias("__day"), "high", "low", "close")
    path = days.join(b, ["instrument", "__day"]).filter((F.col("bar_ts") >= F.col("entry_ts")) & (F.col("bar_ts") <= F.col("exit_ts")))
    minutes = (F.unix_micros(F.col("bar_ts").cast("timestamp")) - F.unix_micros(F.col("entry_ts").cast("timestamp"))) / 60e6
    long = F.col("sign") == 1
    fav = F.when(long, F.col("high") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("low"))
    adv = F.when(long, F.col("entry_price") - F.col("low")).otherwise(F.col("high") - F.col("entry_price"))
    path = path.withColumn("m", minutes).withColumn("fav", fav).withColumn("adv", adv).withColumn("floating", (F.col("close") - F.col("entry_price")) * F.col("sign"))
    bar = F.struct("bar_ts", "m", "fav", "adv", "floating", "close")
    keys = ["trade_id", "instrument", "rule_id", "direction", "sign", "entry_ts", "entry_price", "target", "stop", "exit_ts", "exit_reason"]
    held = path.groupBy(*keys).agg(F.sort_array(F.collect_list(bar)).alias("bars"))  # the bars of one holding time
    final = F.element_at("bars", -1)
    held = held.withColumn("minutes", final["m"])
    held = held.withColumn("exit_price", F.when(F.col("exit_reason") == "stop_loss", F.col("stop")).when(F.col("exit_reason") == "take_profit", F.col("target")).otherwise(final["close"]))
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("mae", "mfe", "at_mae", "at_mfe", "speed", "peak")), F.lit(0).alias("backs"))

    def step(a, x):
        more, worse = x["fav"] > a["mfe"], x["adv"] > a["mae"]
        pace = F.when(x["m"] > 0, x["fav"] / F.nullif(x["m"], F.lit(0.0))).otherwise(x["fav"])
        rise = x["fav"] > a["peak"]
        fell = ~rise & (a["peak"] > 0) & ((a["peak"] - x["floating"]) > PULLBACK * a["peak"])
        return F.struct(
            F.when(worse, x["adv"]).otherwise(a["mae"]).alias("mae"), F.when(more, x["fav"]).otherwise(a["mfe"]).alias("mfe"), F.when(worse, x["m"]).otherwise(a["at_mae"]).alias("at_mae"),
            F.when(more, x["m"]).otherwise(a["at_mfe"]).alias("at_mfe"), F.when(more & (pace > a["speed"]), pace).otherwise(a["speed"]).alias("speed"),
            F.when(rise, x["fav"]).when(fell, F.greatest(F.lit(0.0), x["floating"])).otherwise(a["peak"]).alias("peak"), (a["backs"] + fell.cast("int")).alias("backs"),
        )

    held = held.withColumn("f", F.aggregate("bars", zero, step)).withColumn("n", F.size("bars").cast("double"))
    ys = F.transform("bars", lambda x: x["floating"])
    held = held.withColumn("__sy", F.aggregate(ys, F.lit(0.0), lambda a, y: a + y)).withColumn("__sxy", F.aggregate(F.transform(ys, lambda y, i: y * (i + 1)), F.lit(0.0), lambda a, y: a + y))
    n = F.col("n")
    slope = F.when(n > 1, (n * F.col("__sxy") - n * (n + 1) / 2 * F.col("__sy")) / F.nullif(n * n * (n * n - 1) / 12, F.lit(0.0))).otherwise(0.0)
    held = held.withColumn("pnl_points", (F.col("exit_price") - F.col("entry_price")) * F.col("sign"))
    out = held.select(
        "trade_id", "instrument", "rule_id", "direction", "entry_ts", "entry_price", "exit_ts", "exit_price", "exit_reason", "minutes", "pnl_points", (F.col("pnl_points") * value * lots - commission).alias("pnl_money"),
        F.col("f.mae").alias("mae"), F.col("f.mfe").alias("mfe"), F.col("f.at_mae").alias("minutes_to_mae"), F.col("f.at_mfe").alias("minutes_to_mfe"), F.col("f.speed").alias("max_speed"),
        slope.alias("slope"), F.col("f.backs").alias("pullbacks"), F.when(F.col("f.mfe") > 0, F.col("pnl_points") / F.nullif(F.col("f.mfe"), F.lit(0.0))).otherwise(0.0).alias("efficiency"),
    )
    return out.join(p.select("trade_id", *kept), "trade_id") if kept else out
