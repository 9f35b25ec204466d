"""Joins with intervals of time by calendar bins: no nested loop, whatever the number of intervals.

An interval [a, b) is written once for each month that it meets. Rows meet intervals by an equi-join on the month; two
intervals meet in every month they share, and count in the first of these alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Interval months that are broadcast to the rows; beyond, both sides are shuffled by month.
NEAR = 100_000


def month(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def in_months(df: DataFrame, a: str, b: str, name: str = "__month") -> DataFrame:
    """Rows that are intervals [a, b), once for each month that they meet; empty ones go."""
    end = F.col(b).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(0.000001))
    return df.filter(F.col(a) < F.col(b)).withColumn(name, F.explode(F.sequence(month(F.col(a)), month(end))))


def inside(points: DataFrame, ts: str, intervals: DataFrame, a: str, b: str, how: str = "inner") -> DataFrame:
    """Points with every interval that holds them; ``how`` is inner, or left to keep points that none holds."""
    cut = in_months(intervals, a, b)
    cut = F.broadcast(cut) if cut.count() <= NEAR else cut
    held = (F.col("__at") == F.col("__month")) & (F.col(ts) >= F.col(a)) & (F.col(ts) < F.col(b))
    return points.withColumn("__at", month(F.col(ts))).join(cut, held, how).drop("__at", "__month")


def overlaps(left: DataFrame, right: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Pairs of intervals [a, b) of ``left`` and [c, d) of ``right`` that overlap, each once."""
    both = in_months(left, a, b, "__l").join(in_months(right, c, d, "__r"), (F.col("__l") == F.col("__r")) & (F.col(a) < F.col(d)) & (F.col(c) < F.col(b)))
    return both.filter(F.col("__l") == F.greatest(month(F.col(a)), month(F.col(c)))).drop("__l", "__r")
