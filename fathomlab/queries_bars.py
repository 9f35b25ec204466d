"""Registered queries over bars, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .functions.calendar import parts, session_code
from .model import Instrument
from .operators import bars as ops, features, indicators, rules
from .operators.ordered import moving
from .operators.simulate import simulate
from .sources.views import bars_h1, read

NY = "America/New_York"
H1 = """h AS (SELECT event_type AS instrument, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS tick_volume, 0.0::DOUBLE AS volume, 1.0::DOUBLE AS spread FROM events GROUP BY 1, 2)"""
INSTRUMENT = Instrument("events", "EVENTS", "UTC", open_minute=540, close_minute=960)
Q, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def r6(*names: str):
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]


@query("s12_bar_scan", f"WITH {H1} SELECT instrument, ts, open, high, low, close, tick_volume FROM h WHERE ts >= (SELECT min(ts) + INTERVAL 5 DAY FROM h)")
def bar_scan(spark, sf_dir) -> DataFrame:
    h = bars_h1(spark, sf_dir)
    start = h.agg((F.min("ts") + F.expr("INTERVAL 5 DAYS")).alias("start"))
    return h.join(F.broadcast(start)).filter("ts >= start").select("instrument", "ts", "open", "high", "low", "close", "tick_volume")


OHLC = "arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(tick_volume) AS tick_volume, count(*) AS bar_count"


@query("g12_resample_h4", f"WITH {H1} SELECT instrument, make_timestamp((epoch_us(ts) // 14400000000) * 14400000000) AS ts, {OHLC} FROM h GROUP BY 1, 2")
def resample_h4(spark, sf_dir) -> DataFrame:
    return ops.resample(bars_h1(spark, sf_dir), "H4").drop("volume", "spread")


@query("g12_resample_d1", f"WITH {H1} SELECT instrument, min(ts) AS ts, {OHLC} FROM h GROUP BY instrument, CAST(timezone('{NY}', timezone('UTC', ts)) AS DATE)")
def resample_d1(spark, sf_dir) -> DataFrame:
    return ops.resample(bars_h1(spark, sf_dir), "D1", NY).drop("volume", "spread")


DAILY = f"d AS (SELECT instrument, CAST(ts AS DATE) AS session_date, {OHLC} FROM h GROUP BY 1, 2)"


@query("g13_j4_daily", f"WITH {H1}, {DAILY} SELECT instrument, CAST(session_date AS VARCHAR) AS session_date, open, high, low, close, bar_count, lag(high) OVER w AS prev_high, lag(low) OVER w AS prev_low, lag(close) OVER w AS prev_close FROM d WINDOW w AS (PARTITION BY instrument ORDER BY session_date)")
def daily(spark, sf_dir) -> DataFrame:
    return ops.daily(bars_h1(spark, sf_dir), "UTC").select("instrument", F.col("session_date").cast("string").alias("session_date"), "open", "high", "low", "close", "bar_count", "prev_high", "prev_low", "prev_close")


@query("g13_running_session", f"WITH {H1} SELECT instrument, ts, first(open) OVER w AS today_open, max(high) OVER w AS today_high, min(low) OVER w AS today_low, sum(tick_volume) OVER w AS today_volume, count(*) OVER w AS today_bars FROM h WINDOW w AS (PARTITION BY instrument, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)")
def running(spark, sf_dir) -> DataFrame:
    return ops.running_session(bars_h1(spark, sf_dir), "UTC").select("instrument", "ts", "today_open", "today_high", "today_low", "today_volume", "today_bars")


@query("w10_gaps", f"WITH {H1}, g AS (SELECT instrument, lag(ts) OVER (PARTITION BY instrument ORDER BY ts) AS from_ts, ts AS to_ts FROM h) SELECT instrument, from_ts, to_ts, (epoch_us(to_ts) - epoch_us(from_ts)) / 60e6 AS minutes FROM g WHERE epoch_us(to_ts) - epoch_us(from_ts) > 3600000000")
def gap_query(spark, sf_dir) -> DataFrame:
    return ops.gaps(bars_h1(spark, sf_dir), 60)


@query("g14_coverage", f"WITH {H1} SELECT instrument, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM h GROUP BY 1")
def coverage(spark, sf_dir) -> DataFrame:
    return ops.coverage(bars_h1(spark, sf_dir))


@query("g16_minute_profile", f"WITH {H1}, p AS (SELECT instrument, hour(l) * 60 + minute(l) AS minute, count(*) AS n, sum(tick_volume) AS tick_volume FROM (SELECT *, timezone('{NY}', timezone('UTC', ts)) AS l FROM h) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY tick_volume DESC, minute) AS rank FROM p) SELECT instrument, minute, n, tick_volume, rank, abs(minute - 570) AS distance FROM r WHERE rank <= 8")
def profile(spark, sf_dir) -> DataFrame:
    return ops.minute_profile(bars_h1(spark, sf_dir))


@query("f_calendar_parts", f"SELECT event_id, CAST(CAST(l AS DATE) AS VARCHAR) AS session_date, year(l) AS year, month(l) AS month, day(l) AS day_of_month, isodow(l) AS day_of_week, hour(l) * 60 + minute(l) AS minute_of_day, dayofyear(l) AS day_of_year, CASE WHEN m >= 570 AND m < 600 THEN 1 WHEN m >= 600 AND m < 720 THEN 2 WHEN m >= 720 AND m < 840 THEN 3 WHEN m >= 840 AND m < 960 THEN 4 WHEN m >= 240 AND m < 570 THEN 5 WHEN m >= 960 AND m < 1200 THEN 6 ELSE 0 END AS session FROM (SELECT *, hour(l) * 60 + minute(l) AS m FROM (SELECT event_id, timezone('{NY}', timezone('UTC', ts)) AS l FROM events))")
def calendar(spark, sf_dir) -> DataFrame:
    p = parts(F.col("ts"), NY)
    keep = ("session_date", "year", "month", "day_of_month", "day_of_week", "minute_of_day", "day_of_year")
    return read(spark, sf_dir, "events").select("event_id", *((p[k].cast("string") if k == "session_date" else p[k]).alias(k) for k in keep), session_code(p["minute_of_day"]).alias("session"))


@query("w2_sma", f"WITH {H1} SELECT instrument, ts, CASE WHEN count(*) OVER w >= 20 THEN round(avg(close) OVER w, 6) END AS sma20 FROM h WINDOW w AS (PARTITION BY instrument ORDER BY ts ROWS 19 PRECEDING)")
def sma(spark, sf_dir) -> DataFrame:
    return moving(bars_h1(spark, sf_dir), 19, lambda d: d.withColumn("sma20", F.round(indicators.sma("close", 20), 6))).select("instrument", "ts", "sma20")


@query("w3_true_range", f"WITH {H1}, p AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY ts) AS pc FROM h) SELECT instrument, ts, round(CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END, 6) AS tr FROM p")
def tr(spark, sf_dir) -> DataFrame:
    return moving(bars_h1(spark, sf_dir), 1, lambda d: d.withColumn("tr", F.round(indicators.true_range(), 6))).select("instrument", "ts", "tr")


def recursive_sql(value: str, n: int, alpha: str, name: str) -> str:
    return f"""WITH RECURSIVE {H1}, t AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY ts) AS pc FROM h),
v AS MATERIALIZED (SELECT instrument, ts, {value} AS x, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS k FROM t),
s AS (SELECT instrument, CAST({n} AS BIGINT) AS k, avg(x) AS e FROM v WHERE k <= {n} GROUP BY instrument HAVING count(*) = {n}
  UNION ALL SELECT v.instrument, v.k, s.e + ({alpha}) * (v.x - s.e) FROM s JOIN v ON v.instrument = s.instrument AND v.k = s.k + 1)
SELECT v.instrument, v.ts, round(s.e, 5) AS {name} FROM v LEFT JOIN s ON s.instrument = v.instrument AND s.k = v.k"""


@query("w1_ema", recursive_sql("close", 20, "2.0 / 21", "ema20"))
def ema(spark, sf_dir) -> DataFrame:
    return indicators.ema(bars_h1(spark, sf_dir), 20).select("instrument", "ts", F.round("ema20", 5).alias("ema20"))


@query("w4_atr", recursive_sql("CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END", 14, "1.0 / 14", "atr14"))
def atr(spark, sf_dir) -> DataFrame:
    return indicators.atr(bars_h1(spark, sf_dir), 14).select("instrument", "ts", F.round("atr14", 5).alias("atr14"))


@query("w5_extremes", f"WITH {H1} SELECT instrument, ts, max(high) OVER w AS highest15, min(low) OVER w AS lowest15 FROM h WINDOW w AS (PARTITION BY instrument ORDER BY ts ROWS 14 PRECEDING)")
def extremes(spark, sf_dir) -> DataFrame:
    d = moving(bars_h1(spark, sf_dir), 14, lambda b: b.withColumn("highest15", indicators.highest(15)).withColumn("lowest15", indicators.lowest(15)))
    return d.select("instrument", "ts", "highest15", "lowest15")


@query("w6_session_vwap", f"WITH {H1} SELECT instrument, ts, round(sum((high + low + close) / 3 * tick_volume) OVER w / sum(tick_volume) OVER w, 6) AS vwap FROM h WINDOW w AS (PARTITION BY instrument, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)")
def vwap(spark, sf_dir) -> DataFrame:
    return indicators.session_vwap(bars_h1(spark, sf_dir), "UTC").select("instrument", "ts", *r6("vwap"))


@query("w7_streaks", f"WITH {H1}, s AS (SELECT *, sign(close - open) AS sg, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS k FROM h), g AS (SELECT *, k - row_number() OVER (PARTITION BY instrument, sg ORDER BY k) AS grp FROM s) SELECT instrument, ts, CASE WHEN sg = 1 THEN row_number() OVER w ELSE 0 END AS consecutive_bullish, CASE WHEN sg = -1 THEN row_number() OVER w ELSE 0 END AS consecutive_bearish FROM g WINDOW w AS (PARTITION BY instrument, sg, grp ORDER BY k)")
def streaks(spark, sf_dir) -> DataFrame:
    d = indicators.streaks(bars_h1(spark, sf_dir))
    return d.select("instrument", "ts", F.col("consecutive_bullish").cast("long").alias("consecutive_bullish"), F.col("consecutive_bearish").cast("long").alias("consecutive_bearish"))


@query("w8_running_stats", f"WITH {H1} SELECT instrument, ts, round(sum(close) OVER w, 2) AS total, round(CASE WHEN count(*) OVER w > 1 THEN stddev_samp(close) OVER w END, 5) AS sd FROM h WINDOW w AS (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING)")
def running_stats(spark, sf_dir) -> DataFrame:
    d = indicators.running_stats(bars_h1(spark, sf_dir), "close")
    return d.select("instrument", "ts", F.round("running_sum", 2).alias("total"), F.round("running_sd", 5).alias("sd"))


@query("f1_time", f"WITH {H1}, m AS (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM h) SELECT instrument, ts, m AS time_minuteOfDay, m - 540 AS time_minutesFromOpen, 960 - m AS time_minutesToClose, CAST(m >= 540 AND m < 960 AS INT) AS time_isRegularSession FROM m")
def f1(spark, sf_dir) -> DataFrame:
    t = features.time_features(F.col("ts"), INSTRUMENT)
    return bars_h1(spark, sf_dir).select("instrument", "ts", *(t[k].alias(k) for k in ("time_minuteOfDay", "time_minutesFromOpen", "time_minutesToClose", "time_isRegularSession")))


@query("f2_candle", f"WITH {H1} SELECT instrument, ts, round(high - low, 6) AS candle_range, round(abs(close - open) / nullif(high - low, 0), 6) AS candle_bodyRatio, round((high - greatest(open, close)) / nullif(high - low, 0), 6) AS candle_upperWickRatio, CAST(close > open AS INT) AS candle_isBullish, round(avg(high - low) OVER (PARTITION BY instrument ORDER BY ts ROWS 4 PRECEDING), 6) AS candle_avgRange5 FROM h")
def f2(spark, sf_dir) -> DataFrame:
    return features.candle_features(bars_h1(spark, sf_dir)).select("instrument", "ts", *r6("candle_range", "candle_bodyRatio", "candle_upperWickRatio"), "candle_isBullish", *r6("candle_avgRange5"))


def averages_sql() -> str:
    """Exponential averages (name, values, period, weight) as recursions over numbered bars."""
    out = []
    for name, value, n, alpha in (("a14", "tr", 14, "1.0 / 14"), ("a50", "tr", 50, "1.0 / 50"), ("e20", "close", 20, "2.0 / 21"), ("e50", "close", 50, "2.0 / 51"), ("e200", "close", 200, "2.0 / 201")):
        out.append(f"""{name} AS (SELECT instrument, CAST({n} AS BIGINT) AS k, avg({value}) AS x FROM v WHERE k <= {n} GROUP BY instrument HAVING count(*) = {n}
  UNION ALL SELECT v.instrument, v.k, {name}.x + ({alpha}) * (v.{value} - {name}.x) FROM {name} JOIN v ON v.instrument = {name}.instrument AND v.k = {name}.k + 1)""")
    return ",\n".join(out)


@query("f3_f5_features", f"""WITH RECURSIVE {H1}, q AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY ts) AS pc FROM h),
v AS MATERIALIZED (SELECT *, row_number() OVER w AS k, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, lead(ts) OVER w AS entry_ts,
  max(high) OVER (PARTITION BY instrument ORDER BY ts ROWS 59 PRECEDING) - min(low) OVER (PARTITION BY instrument ORDER BY ts ROWS 59 PRECEDING) AS range60,
  close - sum((high + low + close) / 3 * tick_volume) OVER d / sum(tick_volume) OVER d AS vd
  FROM q WINDOW w AS (PARTITION BY instrument ORDER BY ts), d AS (PARTITION BY instrument, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)),
{averages_sql()},
f AS (SELECT v.*, a14.x AS atr, a50.x AS slow, e20.x AS e20, e50.x AS e50, e200.x AS e200, lag(e20.x, 10) OVER (PARTITION BY v.instrument ORDER BY v.ts) AS e20b FROM v
  LEFT JOIN a14 ON a14.instrument = v.instrument AND a14.k = v.k LEFT JOIN a50 ON a50.instrument = v.instrument AND a50.k = v.k LEFT JOIN e20 ON e20.instrument = v.instrument AND e20.k = v.k
  LEFT JOIN e50 ON e50.instrument = v.instrument AND e50.k = v.k LEFT JOIN e200 ON e200.instrument = v.instrument AND e200.k = v.k)
SELECT instrument, ts, entry_ts, round(atr / nullif(slow, 0), 4) + 0.0 AS volatility_atrRegime, round(atr * 10000 / close, 2) + 0.0 AS volatility_atrPercent, round(range60, 4) + 0.0 AS volatility_range60, round((close - e200) / nullif(atr, 0), 4) + 0.0 AS "trend_distanceEma200Atr",
  round((e20 - e20b) / 10 / nullif(atr, 0), 4) + 0.0 AS "trend_slopeEma20", CAST(CASE WHEN e200 IS NULL THEN NULL WHEN e20 > e50 AND e50 > e200 THEN 1 WHEN e20 < e50 AND e50 < e200 THEN -1 ELSE 0 END AS INT) AS trend_alignment, round(vd / nullif(atr, 0), 4) + 0.0 AS "vwap_distanceAtr" FROM f""")
def f345(spark, sf_dir) -> DataFrame:
    """Volatility, trend and VWAP features of every bar, with the bar at which they are used."""
    b = bars_h1(spark, sf_dir)
    d = features.together(b, features.volatility(), features.trend(), features.vwap("UTC"), entries=True)
    shown = lambda c, k: (F.round(c, k) + 0.0).alias(c)
    return d.select(
        "instrument", "ts", "entry_ts", shown("volatility_atrRegime", 4), shown("volatility_atrPercent", 2), shown("volatility_range60", 4), shown("trend_distanceEma200Atr", 4), shown("trend_slopeEma20", 4),
        "trend_alignment", shown("vwap_distanceAtr", 4),
    )


@query("f6_market", f"WITH {H1}, {DAILY}, p AS (SELECT instrument, session_date, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc FROM d WINDOW w AS (PARTITION BY instrument ORDER BY session_date)), r AS (SELECT *, CAST(ts AS DATE) AS session_date, first(open) OVER w AS o, max(high) OVER w AS th, min(low) OVER w AS tl FROM h WINDOW w AS (PARTITION BY instrument, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)) SELECT r.instrument, ts, round(o - pc, 6) AS market_gapPoints, round(ph - pl, 6) AS market_prevDayRange, round(CASE WHEN ph > pl THEN (th - tl) / (ph - pl) END, 6) AS market_dayRangeUsed FROM r LEFT JOIN p ON p.instrument = r.instrument AND p.session_date = r.session_date")
def f6(spark, sf_dir) -> DataFrame:
    b = bars_h1(spark, sf_dir).withColumn("volatility_atr", F.lit(None).cast("double"))
    return features.market_features(b, "UTC").select("instrument", "ts", *r6("market_gapPoints", "market_prevDayRange", "market_dayRangeUsed"))


@query("f7_opening_session", f"""WITH {H1}, a AS (SELECT *, CAST(ts AS DATE) AS s, hour(ts) * 60 AS m FROM h), o AS (SELECT instrument, s, min(m) AS om, arg_min(open, ts) AS op FROM a WHERE m >= 540 GROUP BY 1, 2),
d AS (SELECT a.instrument, a.s, min(m) AS done FROM a JOIN o USING (instrument, s) WHERE m >= 540 AND m - om >= 179 GROUP BY 1, 2),
x AS (SELECT a.*, om, op, done FROM a LEFT JOIN o USING (instrument, s) LEFT JOIN d USING (instrument, s)),
rg AS (SELECT instrument, s, max(high) AS rh, min(low) AS rl, max_by(close, ts) AS ic FROM x WHERE m >= 540 AND m <= done GROUP BY 1, 2),
y AS (SELECT x.*, rh, rl, ic, max(high) FILTER (WHERE m >= 540) OVER w AS sh, min(low) FILTER (WHERE m >= 540) OVER w AS sl FROM x LEFT JOIN rg USING (instrument, s) WINDOW w AS (PARTITION BY x.instrument, x.s ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT instrument, ts, CAST(sign(ic - op) AS INT) AS impulse, round(CASE WHEN ic >= op THEN sh - op ELSE op - sl END, 6) AS excursion_with, round(CASE WHEN ic >= op THEN sh - close ELSE close - sl END, 6) AS pullback FROM y WHERE m >= done""")
def f7(spark, sf_dir) -> DataFrame:
    d = features.opening_session(bars_h1(spark, sf_dir), "UTC", 540, 180).filter("complete")
    return d.select("instrument", "ts", F.col("impulse").cast("int").alias("impulse"), *r6("excursion_with", "pullback"))


@query("j1_next_bar", f"WITH {H1} SELECT instrument, ts, lead(ts) OVER w AS entry_ts, lead(open) OVER w AS entry_open FROM h WINDOW w AS (PARTITION BY instrument ORDER BY ts)")
def next_bar(spark, sf_dir) -> DataFrame:
    return features.entry_rows(bars_h1(spark, sf_dir)).select("instrument", "ts", "entry_ts", "entry_open")


@query("j5_asof_h4", f"WITH {H1}, q AS (SELECT instrument, make_timestamp((epoch_us(ts) // 14400000000) * 14400000000) + INTERVAL 4 HOUR AS v, arg_max(close, ts) AS h4_close FROM h GROUP BY 1, 2) SELECT h.instrument, h.ts, q.h4_close FROM h ASOF LEFT JOIN q ON q.instrument = h.instrument AND h.ts >= q.v")
def asof(spark, sf_dir) -> DataFrame:
    b = bars_h1(spark, sf_dir)
    h4 = ops.resample(b, "H4").select("instrument", (F.col("ts") + F.expr("INTERVAL 4 HOURS")).alias("visible_from"), F.col("close").alias("h4_close"))
    return features.asof_previous(b, h4, ["h4_close"])


# Entry rules and paths ---------------------------------------------------------------------------

C = f"{H1}, c AS (SELECT *, ts + INTERVAL 1 HOUR AS ct, CAST(ts + INTERVAL 1 HOUR AS DATE) AS cd, hour(ts + INTERVAL 1 HOUR) * 60 AS cm FROM h)"


def closed(spark, sf_dir) -> DataFrame:
    return rules.closed(bars_h1(spark, sf_dir), 60, "UTC")


@query("e1_time_of_day", f"WITH {C} SELECT instrument, ts, unnest(['long', 'short']) AS direction FROM c WHERE cm = 600 AND isodow(ct) <= 5")
def e1(spark, sf_dir) -> DataFrame:
    return rules.time_of_day(closed(spark, sf_dir), 600).select("instrument", "ts", "direction")


@query("e2_scalp_sampler", f"WITH {C} SELECT instrument, ts, unnest(['long', 'short']) AS direction FROM c WHERE cm BETWEEN 540 AND 960 AND (cm - 540) % 120 = 0")
def e2(spark, sf_dir) -> DataFrame:
    return rules.scalp_sampler(closed(spark, sf_dir), 120, 540, 960).select("instrument", "ts", "direction")


@query("e3_opening_range_breakout", f"""WITH {C}, d AS (SELECT instrument, cd, min(cm) AS done FROM c WHERE cm >= 720 GROUP BY 1, 2), r AS (SELECT c.instrument, c.cd, done, max(high) AS rh, min(low) AS rl FROM c JOIN d USING (instrument, cd) WHERE cm >= 540 AND cm <= done GROUP BY ALL),
q AS (SELECT c.instrument, c.cd, ts, CASE WHEN close > rh THEN 'long' ELSE 'short' END AS direction FROM c JOIN r USING (instrument, cd) WHERE cm > done AND cm <= 1320 AND (close > rh OR close < rl)) SELECT instrument, min(ts) AS ts, arg_min(direction, ts) AS direction FROM q GROUP BY instrument, cd""")
def e3(spark, sf_dir) -> DataFrame:
    return rules.opening_range_breakout(closed(spark, sf_dir), 180, 540, 1320).select("instrument", "ts", "direction")


@query("e4_range_fade", f"""WITH {C}, r AS (SELECT instrument, cd, max(high) AS rh, min(low) AS rl FROM c WHERE cm >= 180 AND cm < 480 GROUP BY 1, 2),
q AS (SELECT c.instrument, c.cd, ts, CASE WHEN high >= rh THEN 'short' ELSE 'long' END AS direction FROM c JOIN r USING (instrument, cd) WHERE cm >= 480 AND (high >= rh OR low <= rl)) SELECT instrument, min(ts) AS ts, arg_min(direction, ts) AS direction FROM q GROUP BY instrument, cd""")
def e4(spark, sf_dir) -> DataFrame:
    return rules.range_fade(closed(spark, sf_dir)).select("instrument", "ts", "direction")


@query("e5_opening_reversal", f"""WITH {C}, t AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY ts) AS pc FROM c),
a AS (SELECT *, avg(CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END) OVER (PARTITION BY instrument ORDER BY ts ROWS 13 PRECEDING) AS atr FROM t),
l AS (SELECT instrument, cd, min(cm) AS om, arg_min(open, ts) AS op FROM a WHERE cm >= 540 GROUP BY 1, 2),
d AS (SELECT a.instrument, a.cd, min(cm) AS done, arg_min(close, ts) AS ic FROM a JOIN l ON l.instrument = a.instrument AND l.cd = a.cd WHERE cm >= 540 AND cm - om >= 179 GROUP BY 1, 2),
s AS (SELECT a.*, op, done, ic, max(high) OVER w AS sh, min(low) OVER w AS sl FROM a JOIN l ON l.instrument = a.instrument AND l.cd = a.cd JOIN d ON d.instrument = a.instrument AND d.cd = a.cd WHERE cm >= 540 WINDOW w AS (PARTITION BY a.instrument, a.cd ORDER BY ts)),
q AS (SELECT *, CASE WHEN ic >= op THEN sh - op ELSE op - sl END AS ew, CASE WHEN ic >= op THEN sh - close ELSE close - sl END AS pb FROM s)
SELECT instrument, min(ts) AS ts, arg_min(CASE WHEN ic > op THEN 'short' ELSE 'long' END, ts) AS direction FROM q
WHERE cm >= done AND cm <= 1320 AND ic <> op AND atr > 0 AND abs(ic - op) >= 0.5 * atr AND ew > 0 AND pb / ew >= 0.5 AND pb / ew < 1.5 GROUP BY instrument, cd""")
def e5(spark, sf_dir) -> DataFrame:
    return rules.opening_reversal(closed(spark, sf_dir), "UTC", 180, 540, last=1320).select("instrument", "ts", "direction")


PIVOTS = """pd AS (SELECT instrument, session_date, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc FROM d WINDOW w AS (PARTITION BY instrument ORDER BY session_date)),
pv AS (SELECT *, (ph + pl + pc) / 3 AS pp FROM pd WHERE pc IS NOT NULL),
lv AS (SELECT instrument, session_date, unnest(['pp', 'r1', 's1', 'r2', 's2', 'r3', 's3']) AS level, unnest([pp, 2 * pp - pl, 2 * pp - ph, pp + (ph - pl), pp - (ph - pl), ph + 2 * (pp - pl), pl - 2 * (ph - pp)]) AS price FROM pv)"""


@query("e6_pivot_scalp", f"""WITH RECURSIVE {C}, {DAILY}, {PIVOTS},
t AS MATERIALIZED (SELECT c.instrument, cd, level, ts, open > price AS above, row_number() OVER (PARTITION BY c.instrument, cd, level ORDER BY ts) AS k FROM c JOIN lv ON lv.instrument = c.instrument AND lv.session_date = c.cd WHERE abs(close - price) <= 5),
r AS (SELECT *, ts AS last, true AS given FROM t WHERE k = 1
  UNION ALL SELECT t.*, CASE WHEN t.ts >= r.last + INTERVAL 2 HOUR THEN t.ts ELSE r.last END, t.ts >= r.last + INTERVAL 2 HOUR FROM r JOIN t ON t.instrument = r.instrument AND t.cd = r.cd AND t.level = r.level AND t.k = r.k + 1)
SELECT instrument, ts, CASE WHEN above THEN 'long' ELSE 'short' END AS direction, 'pivot-scalp' AS rule_id FROM r WHERE given""")
def e6(spark, sf_dir) -> DataFrame:
    b = bars_h1(spark, sf_dir)
    return rules.pivot_scalp(rules.closed(b, 60, "UTC"), ops.daily(b, "UTC"), tolerance=5, cooldown=120, start=0, end=1439).select("instrument", "ts", "direction", "rule_id")


SIM = f"""WITH {C}, n AS (SELECT instrument, ts, lead(ts) OVER w AS ets, lead(open) OVER w AS eo FROM h WINDOW w AS (PARTITION BY instrument ORDER BY ts)),
sg AS (SELECT instrument, ts, unnest(['long', 'short']) AS direction FROM c WHERE cm BETWEEN 540 AND 960 AND (cm - 540) % 120 = 0),
p AS (SELECT sg.instrument, direction, ets AS entry_ts, CASE WHEN direction = 'long' THEN 1 ELSE -1 END AS sn, eo + (CASE WHEN direction = 'long' THEN 1 ELSE -1 END) * 1.0 AS ep FROM sg JOIN n ON n.instrument = sg.instrument AND n.ts = sg.ts WHERE ets IS NOT NULL),
b AS (SELECT p.*, h.ts AS bts, high, low, close, (epoch_us(h.ts) - epoch_us(entry_ts)) / 60e6 AS m,
  CASE WHEN (sn = 1 AND low <= ep - 150) OR (sn = -1 AND high >= ep + 150) THEN 'stop_loss' WHEN (sn = 1 AND high >= ep + 150) OR (sn = -1 AND low <= ep - 150) THEN 'take_profit' WHEN (epoch_us(h.ts) - epoch_us(entry_ts)) / 60e6 >= 360 THEN 'time_limit' END AS reason
  FROM p JOIN h ON h.instrument = p.instrument AND h.ts >= entry_ts AND h.ts < entry_ts + INTERVAL 3 DAY),
x AS (SELECT instrument, direction, entry_ts, min(bts) FILTER (WHERE reason IS NOT NULL) AS xts FROM b GROUP BY ALL),
y AS (SELECT b.*, xts FROM b JOIN x USING (instrument, direction, entry_ts) WHERE xts IS NULL OR bts <= xts)
SELECT instrument, direction, entry_ts, round(any_value(ep), 6) AS entry_price, max(bts) AS exit_ts, coalesce(max_by(reason, bts), 'session_end') AS exit_reason,
 round(CASE coalesce(arg_max(coalesce(reason, '-'), bts), '-') WHEN 'stop_loss' THEN -150 WHEN 'take_profit' THEN 150 ELSE (arg_max(close, bts) - any_value(ep)) * any_value(sn) END, 6) AS pnl_points,
 round(greatest(0, max(CASE WHEN sn = 1 THEN ep - low ELSE high - ep END)), 6) AS mae, round(greatest(0, max(CASE WHEN sn = 1 THEN high - ep ELSE ep - low END)), 6) AS mfe,
 round(CASE WHEN count(*) > 1 THEN regr_slope((close - ep) * sn, k) ELSE 0 END, 6) AS slope
FROM (SELECT *, row_number() OVER (PARTITION BY instrument, direction, entry_ts ORDER BY bts) AS k FROM y) GROUP BY instrument, direction, entry_ts"""


def _simulated(spark, sf_dir) -> DataFrame:
    b = bars_h1(spark, sf_dir)
    signals = rules.scalp_sampler(rules.closed(b, 60, "UTC"), 120, 540, 960, tp=150, sl=150, hold=360)
    return simulate(signals, b, INSTRUMENT)


@query("x_simulate", SIM)
def sim(spark, sf_dir) -> DataFrame:
    return _simulated(spark, sf_dir).select("instrument", "direction", "entry_ts", *r6("entry_price"), "exit_ts", "exit_reason", *r6("pnl_points", "mae", "mfe", "slope"))


PATH = SIM[: SIM.rindex("SELECT instrument, direction, entry_ts, round(any_value(ep)")].replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
z AS MATERIALIZED (SELECT *, row_number() OVER w AS k, CASE WHEN sn = 1 THEN high - ep ELSE ep - low END AS fav, CASE WHEN sn = 1 THEN ep - low ELSE high - ep END AS adv, (close - ep) * sn AS fl,
  greatest(0, max(CASE WHEN sn = 1 THEN high - ep ELSE ep - low END) OVER (PARTITION BY instrument, direction, entry_ts ORDER BY bts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS before
  FROM y WINDOW w AS (PARTITION BY instrument, direction, entry_ts ORDER BY bts)),
s AS (SELECT DISTINCT instrument, direction, entry_ts, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS peak, CAST(0 AS INT) AS backs FROM z
  UNION ALL SELECT z.instrument, z.direction, z.entry_ts, z.k, CASE WHEN z.fav > s.peak THEN z.fav WHEN s.peak > 0 AND s.peak - z.fl > 0.35 * s.peak THEN greatest(0.0, z.fl) ELSE s.peak END,
    s.backs + CASE WHEN NOT z.fav > s.peak AND s.peak > 0 AND s.peak - z.fl > 0.35 * s.peak THEN 1 ELSE 0 END
  FROM s JOIN z ON z.instrument = s.instrument AND z.direction = s.direction AND z.entry_ts = s.entry_ts AND z.k = s.k + 1),
g AS (SELECT instrument, direction, entry_ts, max(m) AS minutes, greatest(0, max(fav)) AS mfe, greatest(0, max(adv)) AS mae, max(CASE WHEN fav > coalesce(before, 0) THEN CASE WHEN m > 0 THEN fav / m ELSE fav END END) AS speed,
  CASE coalesce(arg_max(coalesce(reason, '-'), bts), '-') WHEN 'stop_loss' THEN -150 WHEN 'take_profit' THEN 150 ELSE arg_max(fl, bts) END AS pnl FROM z GROUP BY ALL)
SELECT g.instrument, g.direction, g.entry_ts, minutes, (SELECT coalesce(min(m), 0) FROM z WHERE z.instrument = g.instrument AND z.direction = g.direction AND z.entry_ts = g.entry_ts AND adv = g.mae AND adv > 0) AS minutes_to_mae,
  (SELECT coalesce(min(m), 0) FROM z WHERE z.instrument = g.instrument AND z.direction = g.direction AND z.entry_ts = g.entry_ts AND fav = g.mfe AND fav > 0) AS minutes_to_mfe,
  round(coalesce(greatest(0, speed), 0), 6) AS max_speed, (SELECT max(backs) FROM s WHERE s.instrument = g.instrument AND s.direction = g.direction AND s.entry_ts = g.entry_ts) AS pullbacks,
  round(CASE WHEN mfe > 0 THEN pnl / mfe ELSE 0 END, 5) AS efficiency, round(pnl, 6) AS pnl_money FROM g"""


@query("x_path_details", PATH)
def details(spark, sf_dir) -> DataFrame:
    return _simulated(spark, sf_dir).select("instrument", "direction", "entry_ts", "minutes", "minutes_to_mae", "minutes_to_mfe", *r6("max_speed"), "pullbacks", (F.round("efficiency", 5) + 0.0).alias("efficiency"), *r6("pnl_money"))
