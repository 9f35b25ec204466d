"""Live bars: a watched folder of bar files, resampled as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import ValidationError
from ..functions.calendar import local
from ..model import BAR_SCHEMA, TIMEFRAMES


def bar_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Bars as an unbounded table: Parquet files of the bar schema, each read once."""
    return spark.readStream.schema(BAR_SCHEMA).parquet(folder)


def resample_stream(bars: DataFrame, timeframe: str, late: str = "10 minutes", tz: str | None = None) -> DataFrame:
    """Closed bars of a longer timeframe: a bucket is given out once the watermark passes its end. Bars
    that repeat a key within the watermark count once; the spread is that of the last bar. D1 is the market's day and
    needs its zone ``tz``: time and watermark are then those of the market's clock, and a day carries the time of its first bar."""
    daily = timeframe == "D1"
    if daily and not tz:
        raise ValidationError("D1 is a day of the market: give its time zone")
    clock = local(F.col("ts"), tz) if daily else F.col("ts")
    d = bars.withColumn("at", clock.cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["instrument", "timeframe", "ts"])
    return (
        d.groupBy("instrument", F.window("at", f"{TIMEFRAMES[timeframe]} minutes"))
        .agg(
            F.min("ts").alias("first_ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
            F.sum("tick_volume").alias("tick_volume"), F.sum("volume").alias("volume"), F.max_by("spread", "ts").alias("spread"), F.count("*").alias("bar_count"),
        )
        .select(
            "instrument", (F.col("first_ts") if daily else F.col("window.start").cast("timestamp_ntz")).alias("ts"), "open", "high", "low", "close", "tick_volume", "volume", "spread", "bar_count"
        )
    )


def session_stream(bars: DataFrame, tz: str, late: str = "10 minutes", idle: str = "36 hours") -> DataFrame:
    """The running session after every bar (open, extremes, volume, bars so far), by keyed state of instrument and
    session date. A bar that is not later than the last one of its session is ignored: what was given out is
    complete. A session's state goes once the watermark is ``idle`` past it."""
    hold = int(pd.Timedelta(idle).total_seconds() * 1000)
    d = bars.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).withColumn("session_date", local(F.col("ts"), tz).cast("date"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, first, high, low, volume, count = state.get if state.exists else (0, 0.0, float("-inf"), float("inf"), 0.0, 0)
        for frame in [pd.concat(list(frames)).sort_values("ts")]:
            micros = frame["ts"].astype("datetime64[us]").astype("int64")
            frame = frame[micros > last].drop_duplicates("ts")
            if not len(frame):
                continue
            first = first if count else float(frame["open"].iloc[0])
            out = pd.DataFrame({
                "instrument": key[0], "ts": frame["ts"], "today_open": first, "today_high": frame["high"].cummax().clip(lower=high), "today_low": frame["low"].cummin().clip(upper=low),
                "today_volume": frame["tick_volume"].cumsum() + volume, "today_bars": range(count + 1, count + len(frame) + 1),
            })
            last, high, low, volume, count = int(micros.max()), float(out["today_high"].iloc[-1]), float(out["today_low"].iloc[-1]), float(out["today_volume"].iloc[-1]), count + len(frame)
            yield out
        state.update((last, first, high, low, volume, count))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs() + 1) + hold)

    out = "instrument string, ts timestamp_ntz, today_open double, today_high double, today_low double, today_volume double, today_bars long"
    kept = "last long, first double, high double, low double, volume double, count long"
    return d.groupBy("instrument", "session_date").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def sliding_stream(bars: DataFrame, size: int) -> DataFrame:
    """The mean of the last ``size`` closes after every bar (null until there are so many): the state of an
    instrument is a buffer of its last closes."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (0, [])
        frame = pd.concat(list(frames)).sort_values("ts").drop_duplicates("ts")
        micros = frame["ts"].astype("datetime64[us]").astype("int64")
        frame, micros = frame[micros > last], micros[micros > last]
        if len(frame):
            closes = pd.Series([*held, *frame["close"]], dtype=float)
            mean = closes.rolling(size).mean().iloc[len(held) :]
            yield pd.DataFrame({"instrument": key[0], "ts": frame["ts"].to_numpy(), "mean": mean.to_numpy()})
            last, held = int(micros.max()), closes.iloc[1 - size :].tolist() if size > 1 else []
        state.update((last, held))

    return bars.groupBy("instrument").applyInPandasWithState(step, "instrument string, ts timestamp_ntz, mean double", "last long, held array<double>", "append", GroupStateTimeout.NoTimeout)


def indicator_stream(bars: DataFrame, ema: int = 20, atr: int = 14) -> DataFrame:
    """Exponential average of closes and average true range after every bar, null until there are enough: the state of an
    instrument is a few numbers, however long it runs. Bars that are not later than the last one are ignored."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, mean, spread, before = state.get if state.exists else (0, 0, 0.0, 0.0, None)
        out = []
        for b in pd.concat(list(frames)).sort_values("ts").drop_duplicates("ts").itertuples():
            micros = b.ts.value // 1000
            if micros <= last:
                continue
            size = b.high - b.low if before is None else max(b.high - b.low, abs(b.high - before), abs(b.low - before))
            n += 1
            mean = mean + b.close / ema if n <= ema else mean + 2 / (ema + 1) * (b.close - mean)
            spread = spread + size / atr if n <= atr else spread + (size - spread) / atr
            last, before = micros, b.close
            out.append((key[0], b.ts, mean if n >= ema else None, spread if n >= atr else None))
        state.update((last, n, mean, spread, before))
        if out:
            yield pd.DataFrame(out, columns=["instrument", "ts", "ema", "atr"])

    kept = "last long, n long, mean double, spread double, before double"
    return bars.groupBy("instrument").applyInPandasWithState(step, "instrument string, ts timestamp_ntz, ema double, atr double", kept, "append", GroupStateTimeout.NoTimeout)


def trade_stream(
    bars: DataFrame, minute: int, tz: str, minutes: int = 1, tp: float = 40, sl: float = 40, hold: float = 120, days: tuple[int, ...] = (1, 2, 3, 4, 5),
    spread: float = 1.0, slippage: float = 0.5, late: str = "10 minutes", idle: str = "36 hours",
) -> DataFrame:
    """The time-of-day rule live: both directions at the bar after the one that closes at ``minute``, each given out when it
    ends. The state of an instrument is what is open. When the watermark is ``idle`` past its last bar, a timer ends what is
    open there at that bar's close."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    close = local(F.col("ts") + F.make_dt_interval(mins=F.lit(minutes)), tz)
    due = (F.hour(close) * 60 + F.minute(close) == minute) & (F.weekday(close) + 1).isin(*days)
    d = bars.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).withColumn("due", due)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, price, pending, opened, signs, entries = state.get if state.exists else (0, 0.0, False, [], [], [])
        held = list(zip(opened, signs, entries))
        out: list[tuple] = []

        def close_(position: tuple, micros: int, at: float, reason: str) -> None:
            begun, sign, entry = position
            out.append((key[0], "long" if sign > 0 else "short", pd.Timestamp(begun, unit="us"), entry, pd.Timestamp(micros, unit="us"), reason, (at - entry) * sign))

        if state.hasTimedOut:
            for position in held:
                close_(position, last, price, "session_end")
            state.remove()
        else:
            for b in pd.concat(list(frames)).sort_values("ts").drop_duplicates("ts").itertuples():
                micros = b.ts.value // 1000
                if micros <= last:
                    continue
                if pending:
                    held += [(micros, sign, b.open + sign * (spread / 2 + slippage)) for sign in (1, -1)]
                left = []
                for position in held:
                    begun, sign, entry = position
                    worst, best = (b.low, b.high) if sign > 0 else (b.high, b.low)
                    if (worst - entry) * sign <= -sl:
                        close_(position, micros, entry - sign * sl, "stop_loss")
                    elif (best - entry) * sign >= tp:
                        close_(position, micros, entry + sign * tp, "take_profit")
                    elif micros - begun >= hold * 60_000_000:
                        close_(position, micros, b.close, "time_limit")
                    else:
                        left.append(position)
                last, price, pending, held = micros, b.close, bool(b.due), left
            state.update((last, price, pending, [x[0] for x in held], [x[1] for x in held], [x[2] for x in held]))
            state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs() + 1) + wait)
        if out:
            yield pd.DataFrame(out, columns=["instrument", "direction", "entry_ts", "entry_price", "exit_ts", "exit_reason", "pnl_points"])

    out = "instrument string, direction string, entry_ts timestamp_ntz, entry_price double, exit_ts timestamp_ntz, exit_reason string, pnl_points double"
    kept = "last long, price double, pending boolean, opened array<long>, signs array<int>, entries array<double>"
    return d.groupBy("instrument").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


class Progress(StreamingQueryListener):
    """What streams have read so far: (run, batch, rows, rows a second) of each batch, and how each run ended."""

    def __init__(self):
        self.batches: list[tuple[str, int, int, float]] = []
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((str(p.runId), p.batchId, p.numInputRows, p.processedRowsPerSecond))

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)] = event.exception

    def rows(self, query: StreamingQuery) -> int:
        return sum(n for run, _, n, _ in self.batches if run == str(query.runId))


def run_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Work through everything that is there now, into Parquet files, and stop. A :class:`Progress` that listens to the session
    hears how many rows each batch read."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
