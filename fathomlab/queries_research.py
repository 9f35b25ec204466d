"""Registered queries over whole research runs, with their DuckDB oracles: all features of every bar, and all trades of all
rules with the features known at their entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .operators import research
from .plans.builtin import VARIABLES, builtin_plugins, keys_of
from .plans.plugins import Plugin
from .queries_bars import H1, INSTRUMENT, ORACLE as BARS, SIM, averages_sql
from .sources.views import bars_h1

Q, ORACLE = {}, {}

#: Settings of the rules and features that make sense on hourly bars.
EXITS = {"tp": 150, "sl": 150, "hold": 360}
SETTINGS = {
    "opening-session": {"open_minute": 540, "range_minutes": 180},
    "entry-time-of-day": {"minute": 600, **EXITS},
    "entry-scalp-sampler": {"interval": 120, "start": 540, "end": 960, **EXITS},
    "entry-opening-range-breakout": {"minutes": 180, "open_minute": 540, "last": 1320, **EXITS},
    "entry-range-fade": EXITS,
    "entry-opening-reversal": {"minutes": 180, "open_minute": 540, "last": 1320, **EXITS},
    "entry-pivot-scalp": {"tolerance": 5, "cooldown": 120, "start": 0, "end": 1439, **EXITS},
}
RULES = {
    "entry-time-of-day": "e1_time_of_day", "entry-scalp-sampler": "e2_scalp_sampler", "entry-opening-range-breakout": "e3_opening_range_breakout", "entry-range-fade": "e4_range_fade",
    "entry-opening-reversal": "e5_opening_reversal", "entry-pivot-scalp": "e6_pivot_scalp",
}
KEYS = [k for space, names in VARIABLES.items() for k in keys_of(space, names)]
TIME = ["time." + k for k in "minuteOfDay hour minute dayOfWeek dayOfMonth month year minutesFromOpen minutesToClose session isRegularSession".split()]

#: Every variable of each hourly bar (relation ft: instrument, ts, k, entry_ts, and a column for each).
FEATURES = f"""{H1},
q AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY ts) AS pc, CAST(ts AS DATE) AS s, hour(ts) * 60 + minute(ts) AS m, sign(close - open) AS sg, high - low AS sz FROM h),
v AS MATERIALIZED (SELECT *, row_number() OVER w AS k, CASE WHEN pc IS NULL THEN sz ELSE greatest(sz, abs(high - pc), abs(low - pc)) END AS tr, lead(ts) OVER w AS entry_ts,
  max(high) OVER w5 - min(low) OVER w5 AS range5, max(high) OVER w15 - min(low) OVER w15 AS range15, max(high) OVER w60 - min(low) OVER w60 AS range60, avg(sz) OVER w5 AS avg5,
  CASE WHEN count(*) OVER w60 >= 60 THEN avg(tick_volume) OVER w60 END AS vol60,
  sum((high + low + close) / 3 * tick_volume) OVER d / sum(tick_volume) OVER d AS vwap, first(open) OVER d AS o, max(high) OVER d AS th, min(low) OVER d AS tl
  FROM q WINDOW w AS (PARTITION BY instrument ORDER BY ts), w5 AS (PARTITION BY instrument ORDER BY ts ROWS 4 PRECEDING), w15 AS (PARTITION BY instrument ORDER BY ts ROWS 14 PRECEDING),
  w60 AS (PARTITION BY instrument ORDER BY ts ROWS 59 PRECEDING), d AS (PARTITION BY instrument, s ORDER BY ts ROWS UNBOUNDED PRECEDING)),
{averages_sql()},
st AS (SELECT instrument, ts, CASE WHEN sg = 1 THEN row_number() OVER g ELSE 0 END AS up, CASE WHEN sg = -1 THEN row_number() OVER g ELSE 0 END AS down
  FROM (SELECT *, k - row_number() OVER (PARTITION BY instrument, sg ORDER BY k) AS grp FROM v) WINDOW g AS (PARTITION BY instrument, sg, grp ORDER BY k)),
dd AS (SELECT instrument, s, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pcl FROM (SELECT instrument, s, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM q GROUP BY 1, 2) WINDOW w AS (PARTITION BY instrument ORDER BY s)),
op AS (SELECT instrument, s, min(m) AS om, arg_min(open, ts) AS oprice FROM q WHERE m >= 540 GROUP BY 1, 2),
dn AS (SELECT q.instrument, q.s, min(m) AS done, arg_min(close, ts) AS ic0 FROM q JOIN op USING (instrument, s) WHERE m >= 540 AND m - om >= 179 GROUP BY 1, 2),
o1 AS (SELECT q.*, om, oprice, done, coalesce(m >= done, false) AS complete, CASE WHEN m >= done THEN ic0 END AS ic, CASE WHEN m >= done THEN sign(ic0 - oprice) END AS imp
  FROM q LEFT JOIN op USING (instrument, s) LEFT JOIN dn USING (instrument, s) WHERE m >= 540),
o2 AS (SELECT *, max(high) FILTER (WHERE done IS NULL OR m <= done) OVER w AS rh, min(low) FILTER (WHERE done IS NULL OR m <= done) OVER w AS rl, max(high) OVER w AS sh, min(low) OVER w AS sl,
  complete AND ((imp > 0 AND low <= oprice) OR (imp < 0 AND high >= oprice)) AS crossed FROM o1 WINDOW w AS (PARTITION BY instrument, s ORDER BY ts ROWS UNBOUNDED PRECEDING)),
o3 AS (SELECT *, CASE WHEN complete AND close > rh THEN 1 WHEN complete AND close < rl THEN -1 END AS side, CASE WHEN imp >= 0 THEN sh - oprice ELSE oprice - sl END AS ew,
  CASE WHEN imp >= 0 THEN oprice - sl ELSE sh - oprice END AS ea, CASE WHEN imp >= 0 THEN sh - close ELSE close - sl END AS pb FROM o2),
o4 AS (SELECT *, min(m) FILTER (WHERE side IS NOT NULL) OVER w AS bm, arg_min(side, ts) FILTER (WHERE side IS NOT NULL) OVER w AS bs, min(m) FILTER (WHERE crossed) OVER w AS cm
  FROM o3 WINDOW w AS (PARTITION BY instrument, s ORDER BY ts ROWS UNBOUNDED PRECEDING)),
f AS (SELECT v.*, a14.x AS atr, nullif(a14.x, 0) AS a, a50.x AS slow, e20.x AS e20, e50.x AS e50, e200.x AS e200, lag(e20.x, 10) OVER w AS b20, lag(e50.x, 10) OVER w AS b50, lag(e200.x, 10) OVER w AS b200 FROM v
  LEFT JOIN a14 ON a14.instrument = v.instrument AND a14.k = v.k LEFT JOIN a50 ON a50.instrument = v.instrument AND a50.k = v.k LEFT JOIN e20 ON e20.instrument = v.instrument AND e20.k = v.k
  LEFT JOIN e50 ON e50.instrument = v.instrument AND e50.k = v.k LEFT JOIN e200 ON e200.instrument = v.instrument AND e200.k = v.k WINDOW w AS (PARTITION BY v.instrument ORDER BY v.ts)),
ft AS (SELECT f.instrument, f.ts, f.k, f.entry_ts,
  f.sz AS candle_range, abs(f.close - f.open) AS candle_body, f.high - greatest(f.open, f.close) AS "candle_upperWick", least(f.open, f.close) - f.low AS "candle_lowerWick",
  abs(f.close - f.open) / nullif(f.sz, 0) AS "candle_bodyRatio", (f.high - greatest(f.open, f.close)) / nullif(f.sz, 0) AS "candle_upperWickRatio", (least(f.open, f.close) - f.low) / nullif(f.sz, 0) AS "candle_lowerWickRatio",
  CAST(f.close > f.open AS INT) AS "candle_isBullish", st.up AS "candle_consecutiveBullish", st.down AS "candle_consecutiveBearish", f.avg5 AS "candle_avgRange5",
  atr AS volatility_atr, slow AS "volatility_atrSlow", atr / nullif(slow, 0) AS "volatility_atrRegime", atr * 10000 / f.close AS "volatility_atrPercent", range5 AS volatility_range5, range15 AS volatility_range15, range60 AS volatility_range60,
  e20 AS trend_ema20, e50 AS trend_ema50, e200 AS trend_ema200, (f.close - e20) / a AS "trend_distanceEma20Atr", (f.close - e200) / a AS "trend_distanceEma200Atr",
  (e20 - b20) / 10 / a AS "trend_slopeEma20", (e50 - b50) / 10 / a AS "trend_slopeEma50", (e200 - b200) / 10 / a AS "trend_slopeEma200",
  CASE WHEN e200 IS NULL THEN NULL WHEN e20 > e50 AND e50 > e200 THEN 1 WHEN e20 < e50 AND e50 < e200 THEN -1 ELSE 0 END AS trend_alignment,
  vwap AS vwap_value, f.close - vwap AS vwap_distance, (f.close - vwap) / a AS "vwap_distanceAtr", sign(f.close - vwap) AS vwap_side,
  o AS "market_dailyOpen", o - pcl AS "market_gapPoints", (o - pcl) / a AS "market_gapAtr", (f.close - o) / a AS "market_distanceToOpenAtr", ph AS "market_prevDayHigh", pl AS "market_prevDayLow", pcl AS "market_prevDayClose",
  ph - pl AS "market_prevDayRange", (f.close - ph) / a AS "market_distanceToPrevHighAtr", (f.close - pl) / a AS "market_distanceToPrevLowAtr", CASE WHEN ph > pl THEN (th - tl) / (ph - pl) END AS "market_dayRangeUsed",
  f.tick_volume AS market_volume, f.tick_volume / vol60 AS "market_relativeVolume",
  o4.m - om AS "nas100_minutesSinceOpen", rh AS "nas100_openingRangeHigh", rl AS "nas100_openingRangeLow", (rh - rl) / a AS "nas100_openingRangeSizeAtr", CAST(complete AS INT) AS "nas100_openingRangeComplete", imp AS "nas100_impulseDirection",
  abs(ic - oprice) / a AS "nas100_impulseSizeAtr", CASE WHEN om IS NOT NULL THEN coalesce(bs, 0) END AS "nas100_breakoutSide", o4.m - bm AS "nas100_minutesSinceBreakout",
  CASE WHEN imp IS NOT NULL THEN ew END / a AS "nas100_excursionWithImpulseAtr", CASE WHEN imp IS NOT NULL THEN ea END / a AS "nas100_excursionAgainstImpulseAtr", CASE WHEN imp IS NOT NULL THEN pb END / a AS "nas100_pullbackFromExtremeAtr",
  CASE WHEN imp IS NOT NULL AND ew > 0 THEN pb / ew END AS "nas100_pullbackFraction", CASE WHEN om IS NOT NULL THEN CAST(cm IS NOT NULL AS INT) END AS "nas100_crossedBackOpen", cm - om AS "nas100_minutesToOpenCross",
  (f.close - (rh + rl) / 2) / a AS "nas100_distanceToRangeMidAtr"
  FROM f JOIN st ON st.instrument = f.instrument AND st.ts = f.ts LEFT JOIN dd ON dd.instrument = f.instrument AND dd.s = f.s LEFT JOIN o4 ON o4.instrument = f.instrument AND o4.ts = f.ts)"""


#: Moves means of prices off the middle between two rounded values; in both engines.
HALF = 3e-8


def _shown(keys: list[str]) -> str:
    return ", ".join(f'round(CAST("{k.replace(".", "_")}" AS DOUBLE) + {HALF}, 6) + 0.0 AS "{k.replace(".", "_")}"' for k in keys)


def query(name: str, sql: str):
    def add(f):
        Q[name], ORACLE[name] = f, sql
        return f

    return add


def _plugins():
    own = builtin_plugins(INSTRUMENT, 60)
    for rule in RULES:
        own.enable(rule)
    return own


@query("run_features", f"WITH RECURSIVE {FEATURES} SELECT instrument, ts, entry_ts, {_shown(KEYS)} FROM ft")
def run_features(spark, sf_dir) -> DataFrame:
    """Every variable of the feature plugins at every bar, and the bar at which it is used."""
    d = research.feature_rows(bars_h1(spark, sf_dir), _plugins(), SETTINGS)
    return d.select("instrument", "ts", "entry_ts", *((F.round(F.col(k.replace(".", "_")).cast("double") + HALF, 6) + 0.0).alias(k.replace(".", "_")) for k in KEYS))


# the simulation's relations, by rule as well, over the signals of all six rules
_OF = "instrument, rule, direction, entry_ts"
_SIGNALS = " UNION ALL ".join(f"SELECT instrument, ts, direction, '{rule}' AS rule FROM ({BARS[name]})" for rule, name in RULES.items())
_TRADES = SIM[SIM.index(", n AS (") : SIM.rindex("SELECT instrument, direction, entry_ts, round(any_value(ep)")].rstrip().replace("instrument, direction, entry_ts", _OF)
_TRADES = _TRADES[: _TRADES.index("sg AS (")] + f"sg AS ({_SIGNALS})" + _TRADES[_TRADES.index(",\np AS (") :].replace("SELECT sg.instrument, direction, ets", "SELECT sg.instrument, sg.rule, direction, ets", 1)
_M = "(hour(entry_ts) * 60 + minute(entry_ts))"
_TIME = f"""{_M} AS "time_minuteOfDay", hour(entry_ts) AS time_hour, minute(entry_ts) AS time_minute, isodow(entry_ts) AS "time_dayOfWeek", day(entry_ts) AS "time_dayOfMonth", month(entry_ts) AS time_month, year(entry_ts) AS time_year,
  {_M} - 540 AS "time_minutesFromOpen", 960 - {_M} AS "time_minutesToClose", CASE WHEN {_M} >= 570 AND {_M} < 600 THEN 1 WHEN {_M} >= 600 AND {_M} < 720 THEN 2 WHEN {_M} >= 720 AND {_M} < 840 THEN 3 WHEN {_M} >= 840 AND {_M} < 960 THEN 4
  WHEN {_M} >= 240 AND {_M} < 570 THEN 5 WHEN {_M} >= 960 AND {_M} < 1200 THEN 6 ELSE 0 END AS time_session, CAST({_M} >= 540 AND {_M} < 960 AS INT) AS "time_isRegularSession\""""
_RUN = f"""WITH RECURSIVE {FEATURES}{_TRADES},
t AS (SELECT {_OF}, any_value(ep) AS ep, max(bts) AS exit_ts, coalesce(max_by(reason, bts), 'session_end') AS exit_reason,
  CASE coalesce(arg_max(coalesce(reason, '-'), bts), '-') WHEN 'stop_loss' THEN -150 WHEN 'take_profit' THEN 150 ELSE (arg_max(close, bts) - any_value(ep)) * any_value(sn) END AS pnl_points,
  greatest(0, max(CASE WHEN sn = 1 THEN ep - low ELSE high - ep END)) AS mae, greatest(0, max(CASE WHEN sn = 1 THEN high - ep ELSE ep - low END)) AS mfe
  FROM y GROUP BY {_OF}),
r AS (SELECT t.*, CAST(CAST(t.entry_ts AS DATE) AS VARCHAR) AS session_date, {_TIME.replace("entry_ts", "t.entry_ts")}, ft.* EXCLUDE (instrument, ts, entry_ts) FROM t JOIN ft ON ft.instrument = t.instrument AND ft.entry_ts = t.entry_ts WHERE ft.k > 250)
SELECT {_OF}, round(ep, 6) AS entry_price, exit_ts, exit_reason, round(pnl_points, 6) AS pnl_points, round(mae, 6) AS mae, round(mfe, 6) AS mfe, session_date, {_shown([*TIME, *KEYS])} FROM r"""


@query("run_research", _RUN)
def run_research(spark, sf_dir) -> DataFrame:
    """Bars to trades: all six rules after the warm-up, the path of every position, and the variables known at its entry."""
    rows = research.run(bars_h1(spark, sf_dir), _plugins(), INSTRUMENT, 60, **SETTINGS).withColumn("f", F.from_json("features", "map<string,double>"))
    known = [(F.round(F.col("f")[k] + HALF, 6) + 0.0).alias(k.replace(".", "_")) for k in (*TIME, *KEYS)]
    return rows.select(
        "instrument", F.substring_index("rule_id", "__", 1).alias("rule"), "direction", "entry_ts", F.round("entry_price", 6).alias("entry_price"), "exit_ts", "exit_reason",
        *((F.round(c, 6) + 0.0).alias(c) for c in ("pnl_points", "mae", "mfe")), F.col("session_date").cast("string").alias("session_date"), *known,
    )


@query("run_failing_plugin", f"WITH RECURSIVE {FEATURES} SELECT instrument, ts, round(volatility_atr, 4) + 0.0 AS volatility_atr, NULL::DOUBLE AS own_ratio, NULL::DOUBLE AS \"trend_ema20\", 2 AS n_failed FROM ft")
def run_failing_plugin(spark, sf_dir) -> DataFrame:
    """One plugin that fails while it runs and one that is set up wrongly: their variables are null, the others' are there."""
    own = _plugins()
    own.add(Plugin("own-ratio", "1.0.0", "feature", lambda d: d.withColumn("own_ratio", F.col("volatility_atr") + F.raise_error(F.lit("broken")).cast("double")), ("own.ratio",), ("volatility.atr",)))
    failed: dict[str, str] = {}
    d = research.feature_rows(bars_h1(spark, sf_dir), own, {**SETTINGS, "core-trend": {"lag": "ten"}}, failed)
    shown = [(F.round(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in ("volatility_atr", "own_ratio", "trend_ema20")]
    return d.select("instrument", "ts", *shown, F.lit(len(failed)).cast("int").alias("n_failed"))
