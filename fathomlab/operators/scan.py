"""Exponential recurrences over series of any length, as a parallel scan of affine maps.

A step of a recurrence is a map s -> a * s + b. While the first n values come in, a is 1 and b their n-th part, so the
state is their mean when the n-th is reached; then a is 1 - alpha and b is alpha times the value. Maps compose, so

* a series is cut into blocks of at most SPAN rows by place; a window inside a block gives the map of each row from the
  block's begin;
* the blocks' maps are scanned by doubling: every round composes each with the one 1, 2, 4 ... places before, inside groups of
  WIDTH blocks; the groups' maps are scanned in the same way, and so on up;
* each row applies its map to the state that enters its block.

No task sees more than WIDTH maps or SPAN rows of a series, and nothing grows with its length but the number of levels. All
recurrences of a pass share one numbering, one window and one scan.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window, functions as F

from ..session import settle
from .ordered import matched, placed

SPAN, WIDTH = 512, 512


def entering(maps: DataFrame, keys: list[str], at: str, names: list[str], count: int) -> DataFrame:
    """keys, ``at`` (0, 1, ... in each series, ``count`` at most) and, for each of ``names``, the state before the map at that
    place, if a series begins at 0. ``maps`` has columns name_a and name_b and is read twice: settled, or cheap."""
    w = Window.partitionBy(*keys, "__group").orderBy("__pos")
    own = [*keys, "__pos", "__group"]
    d = maps.select(*keys, F.col(at).alias("__pos"), F.floor(F.col(at) / WIDTH).alias("__group"), *maps_of(names))
    step = 1
    while step < min(count, WIDTH):
        before = {x: F.coalesce(F.lag(x, step).over(w), F.lit(default)) for n in names for x, default in ((f"{n}_a", 1.0), (f"{n}_b", 0.0))}
        d = d.select(*own, *maps_of(names), *(c.alias(f"__{x}") for x, c in before.items()))
        d = d.select(*own, *(c for n in names for c in ((F.col(f"{n}_a") * F.col(f"__{n}_a")).alias(f"{n}_a"), (F.col(f"{n}_a") * F.col(f"__{n}_b") + F.col(f"{n}_b")).alias(f"{n}_b"))))
        step *= 2
    last = lambda x, default: F.coalesce(F.lag(x).over(w), F.lit(default)).alias(x)
    prior = d.select(*own, *(c for n in names for c in (last(f"{n}_a", 1.0), last(f"{n}_b", 0.0))))
    if count <= WIDTH:
        return prior.select(*keys, F.col("__pos").alias(at), *(F.col(f"{n}_b").alias(n) for n in names))
    tops = settle(d.groupBy(*keys, "__group").agg(*(F.max_by(x, "__pos").alias(x) for x in maps_of(names))))
    prior = matched(prior, entering(tops, keys, "__group", names, -(-count // WIDTH)), [*keys, "__group"])
    return prior.select(*keys, F.col("__pos").alias(at), *((F.col(f"{n}_a") * F.col(n) + F.col(f"{n}_b")).alias(n) for n in names))


def maps_of(names: list[str]) -> list[str]:
    return [f"{n}_{x}" for n in names for x in "ab"]


def recurrences(df: DataFrame, specs: list[tuple[str, str, int, float]], keys: list[str], ts: str = "ts") -> DataFrame:
    """``df`` with a column for each (name, value, n, alpha): null before the n-th value, their mean at it, then
    s + alpha * (value - s)."""
    d = settle(placed(df, keys, ts))
    longest = d.agg(F.max("__at")).first()[0] or 0
    span = max(8, min([SPAN, *(int(200 / -log(1 - alpha)) for _, _, _, alpha in specs if 0 < alpha < 1)]))
    d = d.withColumn("__block", F.floor((F.col("__at") - 1) / span))
    up = Window.partitionBy(*keys, "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names, at = [f"__s{k}" for k in range(len(specs))], F.col("__at")
    shrunk, own = {}, {}
    for name, (_, value, n, alpha) in zip(names, specs):
        a = 1 - alpha if alpha < 1 else 1.0  # with a weight of 1 the state is the value itself
        steps = F.greatest(F.lit(0), at - F.greatest(F.lit(n), F.col("__block") * span))
        shrunk[f"{name}_a"] = F.pow(F.lit(a), steps)
        own[f"{name}_b"] = F.when(at <= n, F.col(value) / n).otherwise(F.lit(alpha) * F.col(value))
    d = d.withColumns(shrunk)
    d = d.withColumns({f"{n}_b": F.col(f"{n}_a") * F.coalesce(F.sum(own[f"{n}_b"] / F.col(f"{n}_a")).over(up), F.lit(0.0)) for n in names})
    ends = settle(d.groupBy(*keys, "__block").agg(*(F.max_by(x, "__at").alias(x) for x in maps_of(names))))
    d = matched(d, entering(ends, keys, "__block", names, -(-longest // span)), [*keys, "__block"])
    for state, (name, value, n, alpha) in zip(names, specs):
        seen = F.when((at > n) & F.lit(alpha >= 1), F.col(value)).when(at >= n, F.col(f"{state}_a") * F.col(state) + F.col(f"{state}_b"))
        d = d.withColumn(name, seen)
    extra = [c for c in ("__at", "__chunk") if c in df.columns]
    return d.select(*dict.fromkeys([*(c for c in df.columns if c not in extra), *(s[0] for s in specs), *extra]))
