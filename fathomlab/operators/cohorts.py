"""Cohorts: the rows that a predicate selects, against the others and against themselves in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window, functions as F

from ..plans.guards import Registry, require_safe
from ..plans.predicates import Predicate, as_filter, as_mask
from ..session import settle
from .metrics import summarize
from .ordered import equity


def cohort_metrics(df: DataFrame, predicate: Predicate, registry: Registry, purpose: str = "hypothesis") -> DataFrame:
    """Metrics of the selected rows, and which share of all they are; all are counted in the pass that selects."""
    require_safe(predicate, registry, purpose)
    rows = Observation()
    found = summarize(df.observe(rows, F.count("*").alias("n")).filter(as_filter(predicate, registry.column)))
    total = rows.get["n"]
    return found.withColumn("coverage", F.col("n") / F.lit(float(total)) if total else F.lit(0.0))


def both_sides(df: DataFrame, predicate: Predicate, registry: Registry) -> DataFrame:
    """Metrics of the cohort and of its complement, in one pass over the rows."""
    return summarize(df.withColumn("side", as_mask(predicate, registry.column)), ["side"])


def halves(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """``df`` with ``half``: 1 for the first floor(n/2) rows in time, 2 for the rest."""
    groups = groups or []
    one = groups or ["__all"]
    d = settle(equity(df if groups else df.withColumn("__all", F.lit(1)), one))
    n = d.groupBy(*one).agg(F.count("*").alias("__count"))
    d = d.join(F.broadcast(n) if not groups else n, one)
    return d.withColumn("half", F.when(F.col("i") < F.floor(F.col("__count") / 2), 1).otherwise(2)).drop("__count", "__all", "i", "equity", "peak", "__chunk")


def stability(df: DataFrame) -> DataFrame:
    """How the second half differs: change of the win rate, ratio of expectancies (null if the first is 0)."""
    by = summarize(halves(df), ["half"])
    pick = lambda c, h: F.max(F.when(F.col("half") == h, F.col(c)))
    return by.agg(
        pick("n", 1).alias("n_first"), pick("n", 2).alias("n_second"), (pick("win_rate", 2) - pick("win_rate", 1)).alias("win_rate_delta"),
        F.try_divide(pick("expectancy", 2), pick("expectancy", 1)).alias("expectancy_ratio"),
    )


def downsample(df: DataFrame, place: str, value: str, most: int = 300) -> DataFrame:
    """Of a numbered series: the rows at floor(k * n / most), and the last one if its value differs
    from the last row kept. Places are whole numbers, as n / most times k in floats falls below some of them."""
    n = df.agg(F.count("*").alias("__n"), F.max_by(value, place).alias("__last"), F.max(place).alias("__end"))
    d = df.join(F.broadcast(n))
    first = f"(CAST({place} AS LONG) * {most} + __n - 1) div __n"  # the first k that reaches the place
    kept = d.filter(f"__n <= {most} OR ({first}) * __n div {most} = {place}")
    tail = kept.agg(F.max_by(value, place).alias("__kept_value"), F.max(place).alias("__kept_end"))
    last = d.join(F.broadcast(tail)).filter((F.col(place) == F.col("__end")) & (F.col("__kept_end") < F.col("__end")) & (F.col("__kept_value") != F.col("__last")))
    return kept.select(*df.columns).unionByName(last.select(*df.columns))


def equity_curve(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    one = groups or ["__all"]
    d = equity(df if groups else df.withColumn("__all", F.lit(1)), one)
    return d.select(*(groups or []), "id", "i", "equity", "peak")


def dedupe(df: DataFrame, key: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row per key: the first (idempotent insert) or last (replace) by ``order``."""
    cols = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    w = Window.partitionBy(*key).orderBy(*cols)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
