"""Synthetic one-minute bars: any number of days, each generated by itself from its own seed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.calendar import to_utc


def mulberry32(seed: int) -> Iterator[float]:
    """The 32-bit generator that seeds reproducible studies; uniform in [0, 1)."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        z = state
        z = ((z ^ (z >> 15)) * (z | 1)) & 0xFFFFFFFF
        z ^= (z + (((z ^ (z >> 7)) * (z | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield ((z ^ (z >> 14)) & 0xFFFFFFFF) / 4294967296


#: How volatile a session's minutes are against the day's base (fixed values): before each minute, the factor.
PROFILE = [(570, 0.45), (585, 3.2), (630, 2.0), (690, 1.2), (840, 0.75), (900, 1.0), (960, 1.6), (1440, 0.4)]
#: The day's base in points a minute: first value, daily change, bounds; a gap's size in bases; the pattern's threshold and strength (fixed values).
BASE, CHANGE, LEAST, MOST, GAP, THRESHOLD, STRENGTH = 3.0, 0.12, 1.2, 12.0, 4.0, 0.8, 0.09
FIRST_PRICE, YEARLY = 16000.0, 0.00004


def factors(minutes: np.ndarray) -> np.ndarray:
    ends = np.array([m for m, _ in PROFILE])
    return np.array([f for _, f in PROFILE])[np.searchsorted(ends, minutes, side="right")]


def generate_bars(
    spark: SparkSession, start: str, days: int, seed: int = 42, instrument: str = "synthetic", tz: str = "America/New_York", pattern: bool = False, first: int = 480, last: int = 959,
) -> DataFrame:
    """Weekday bars from minute ``first`` to ``last`` of the market: volatile at the open and again at the close, with a base that
    drifts from day to day, overnight gaps and, if ``pattern`` is set, a drift against large gaps in the first hour.

    What days hand on (base, gap, net move) is drawn for all of them at once, a few numbers a day; given its net move, a day's
    path depends on (seed, day) alone, so days are made in parallel and still join up."""
    minutes = np.arange(first, last + 1)
    shape = factors(minutes)
    rng = np.random.default_rng(seed)
    week = pd.to_datetime(start).weekday()
    base, opens, nets, gaps, price, now = np.zeros(days), np.zeros(days), np.zeros(days), np.zeros(days), FIRST_PRICE, BASE
    for k in range(days):
        if (week + k) % 7 > 4:
            continue
        now = min(MOST, max(LEAST, now * (1 + CHANGE * rng.standard_normal())))
        gap = rng.standard_normal() * now * GAP
        drift = np.full(len(minutes), YEARLY * price / 1440)
        if pattern and abs(gap) > THRESHOLD * now * GAP:
            drift[(minutes >= 570) & (minutes < 630)] -= np.sign(gap) * STRENGTH * now
        net = drift.sum() + rng.standard_normal() * now * np.sqrt((shape * shape).sum())
        base[k], gaps[k], opens[k], nets[k] = now, gap, price + gap, net
        price += gap + net
    shared = spark.sparkContext.broadcast((base, gaps, opens, nets))  # four numbers a day
    dates = spark.range(days).select(F.col("id").alias("day"), F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date")).filter(F.weekday("date") < 5)

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, gaps, opens, nets = shared.value
        for frame in frames:
            for day, date in zip(frame["day"], frame["date"]):
                rng = np.random.default_rng([seed, int(day)])
                vol = base[day] * shape
                moves = rng.standard_normal(len(minutes)) * vol
                if pattern and abs(gaps[day]) > THRESHOLD * base[day] * GAP:
                    moves[(minutes >= 570) & (minutes < 630)] -= np.sign(gaps[day]) * STRENGTH * base[day]
                moves += (nets[day] - moves.sum()) * vol * vol / (vol * vol).sum()  # as drawn, given their sum
                close = opens[day] + np.cumsum(moves)
                open_ = np.concatenate([[opens[day]], close[:-1]])
                wick = np.abs(rng.standard_normal((2, len(minutes)))) * vol * 0.6
                yield pd.DataFrame({
                    "wall": pd.to_datetime(str(date)) + pd.to_timedelta(minutes, unit="m"), "open": open_.round(1), "high": (np.maximum(open_, close) + wick[0]).round(1),
                    "low": (np.minimum(open_, close) - wick[1]).round(1), "close": close.round(1), "tick_volume": np.round((200 + 2200 * shape / 3.2) * (0.6 + 0.8 * rng.random(len(minutes)))),
                    "spread": 1 + np.round(2 * rng.random(len(minutes))),
                })

    made = dates.mapInPandas(make, "wall timestamp_ntz, open double, high double, low double, close double, tick_volume double, spread double")
    return made.select(F.lit(instrument).alias("instrument"), F.lit("M1").alias("timeframe"), to_utc(F.col("wall"), tz).alias("ts"), "open", "high", "low", "close", "tick_volume", F.lit(0.0).alias("volume"), "spread")
