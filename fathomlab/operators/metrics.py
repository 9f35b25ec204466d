"""Cohort metrics: one row per group from chronological outcomes.

All sums are exact for whole cents. Undefined ratios are null; a profit factor without losses is
infinite. Drawdown, streaks and equity R-squared follow (ts, tie).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.stats import t_p_value, t_statistic, wilson
from ..session import settle
from .ordered import matched, micros, sliced, walked
from .quantiles import group_quantiles

METRICS = [
    "n", "wins", "losses", "break_even", "gross_profit", "gross_loss", "net_profit", "win_rate", "ci_low", "ci_high", "profit_factor", "expectancy",
    "avg_win", "avg_loss", "payoff", "std_dev", "sharpe", "sortino", "max_drawdown", "max_drawdown_pct", "max_drawdown_length", "max_wins", "max_losses",
    "equity_r2", "median", "p05", "p95", "t_stat", "p_value",
]


def sums(pnl: str = "pnl_cents") -> list[Column]:
    """The order-free aggregates; partial sums on the map side."""
    x = F.col(pnl)
    return [
        F.count(x).alias("n"), F.count_if(x > 0).alias("wins"), F.count_if(x < 0).alias("losses"), F.count_if(x == 0).alias("break_even"),
        F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0)).cast("double").alias("gross_profit"), F.coalesce(-F.sum(F.when(x < 0, x)), F.lit(0)).cast("double").alias("gross_loss"),
        F.sum(x.cast("decimal(38,0)") * x.cast("decimal(18,0)")).alias("__xx"), F.sum(F.when(x < 0, x.cast("decimal(38,0)") * x.cast("decimal(18,0)"))).alias("__down"),
    ]


def ratios(df: DataFrame) -> DataFrame:
    """What follows from the sums."""
    n, gp, gl = F.col("n").cast("double"), F.col("gross_profit"), F.col("gross_loss")
    low, high = wilson(F.col("wins"), F.col("wins") + F.col("losses"))
    net = gp - gl
    spread = F.col("__xx").cast("double") - net * net / n
    d = (
        df.withColumn("net_profit", net)
        .withColumn("win_rate", F.try_divide(F.col("wins").cast("double"), (F.col("wins") + F.col("losses")).cast("double")))
        .withColumn("ci_low", F.when(n > 0, low)).withColumn("ci_high", F.when(n > 0, high))
        .withColumn("profit_factor", F.when(gl > 0, gp / gl).when(gp > 0, F.lit(float("inf"))))
        .withColumn("expectancy", F.try_divide(net, n)).withColumn("avg_win", F.try_divide(gp, F.col("wins").cast("double"))).withColumn("avg_loss", F.try_divide(gl, F.col("losses").cast("double")))
        .withColumn("payoff", F.try_divide("avg_win", "avg_loss"))
        .withColumn("std_dev", F.when(n >= 2, F.sqrt(F.greatest(F.lit(0.0), F.when(F.col("__xx") * F.col("n") == (F.col("net_profit").cast("decimal(38,0)") * F.col("net_profit").cast("decimal(18,0)")), 0.0).otherwise(spread)) / F.nullif(n - 1, F.lit(0.0)))))
    )
    down = F.sqrt(F.coalesce(F.col("__down").cast("double"), F.lit(0.0)) / F.nullif(n, F.lit(0.0)))
    d = (
        d.withColumn("sharpe", F.when(F.col("std_dev") > 0, F.col("expectancy") / F.col("std_dev")))
        .withColumn("sortino", F.when(down > 0, F.col("expectancy") / F.nullif(down, F.lit(0.0))))
        .withColumn("t_stat", t_statistic(F.col("n"), F.col("expectancy"), F.col("std_dev")))
    )
    if "__q" in df.columns:
        d = d.withColumns({c: F.col("__q")[k] for k, c in enumerate(("p05", "median", "p95"))})
    return d.withColumn("p_value", t_p_value(F.col("t_stat"), (F.col("n") - 1).cast("double"))).drop("__xx", "__down", "__q")


def first_pass(pnl: str) -> list[Column]:
    """Of walked rows, beside the sums: the deepest fall from a peak, at the first place that attains it, and means."""
    deepest = F.max(F.struct((F.col("peak") - F.col("equity")).alias("dd"), (-F.col("i")).alias("neg"), "peak")).alias("__d")
    return [*sums(pnl), deepest, F.avg(F.col("i").cast("double")).alias("__mi"), F.avg(F.col("equity").cast("double")).alias("__me")]


def second_pass(walked_rows: DataFrame, first: DataFrame, groups: list[str]) -> DataFrame:
    """Per group, drawdown and trend. The greatest fall's share of its peak and its length: the peak's place is its first, and 0
    where the running sum was never above 0. R-squared of the equity on its place is null below three rows or without spread;
    its sums are centred on the group's means, so that long series keep their digits."""
    d = matched(walked_rows, first.select(*groups, "__d", "__mi", "__me"), groups)
    a, b = F.col("i") - F.col("__mi"), F.col("equity") - F.col("__me")
    place = F.min(F.when((F.col("equity") == F.col("__d.peak")) & (F.col("__d.peak") > 0), F.col("i"))).alias("__at")
    s = d.groupBy(*groups).agg(F.first("__d").alias("__d"), place, F.count("*").alias("__n"), F.sum(a * b).alias("__ab"), F.sum(a * a).alias("__aa"), F.sum(b * b).alias("__bb"))
    return s.select(
        *groups,
        F.col("__d.dd").cast("double").alias("max_drawdown"),
        F.when(F.col("__d.peak") > 0, F.col("__d.dd") / F.nullif(F.col("__d.peak"), F.lit(0))).otherwise(0.0).cast("double").alias("max_drawdown_pct"),
        F.when(F.col("__d.dd") > 0, -F.col("__d.neg") - F.coalesce("__at", F.lit(0))).otherwise(0).cast("long").alias("max_drawdown_length"),
        F.when((F.col("__n") >= 3) & (F.col("__aa") > 0) & (F.col("__bb") > 0), F.col("__ab") * F.col("__ab") / (F.col("__aa") * F.nullif("__bb", F.lit(0.0)))).alias("equity_r2"),
    )


def streaks(walked_rows: DataFrame, groups: list[str], pnl: str) -> DataFrame:
    """Longest runs of wins and of losses; a zero ends both."""
    runs = walked_rows.groupBy(*groups, "run", F.signum(F.col(pnl).cast("double")).alias("__sign")).agg(F.count("*").alias("__len"))
    longest = lambda s: F.coalesce(F.max(F.when(F.col("__sign") == s, F.col("__len"))), F.lit(0)).cast("long")
    return runs.groupBy(*groups).agg(longest(1).alias("max_wins"), longest(-1).alias("max_losses"))


def summarize(df: DataFrame, groups: list[str] | None = None, ts: str = "entry_ts", tie: str = "id", pnl: str = "pnl_cents") -> DataFrame:
    """All METRICS, one row per group. Without groups there is one row even for no rows: counts 0,
    drawdowns 0, p 1, ratios null. ``df`` runs once: a few narrow columns of it are kept, with the bounds of their time."""
    groups = groups or []
    rows = df.filter(F.col(pnl).isNotNull())
    one = groups or ["__all"]
    if not groups:
        rows = rows.withColumn("__all", F.lit(1))
    range_ = Observation()
    rows = settle(rows.select(*one, ts, tie, pnl).observe(range_, F.min(micros(ts)).alias("low"), F.max(micros(ts)).alias("high")))
    rows = sliced(rows, ts, bounds=(range_.get["low"], range_.get["high"]))
    eq = walked(rows, one, ts, tie, pnl)
    first = settle(eq.groupBy(*one).agg(*first_pass(pnl)))
    parts = (group_quantiles(rows, one, pnl, [0.05, 0.5, 0.95], "__q"), second_pass(eq, first, one), streaks(eq, one, pnl))
    out = first.drop("__d", "__mi", "__me")
    for part in parts:
        out = matched(out, part, one, "left")
    out = ratios(out)
    if groups:
        return out.select(*groups, *METRICS)
    base = df.sparkSession.range(1).select(F.lit(1).alias("__all"))
    zero = {c: F.lit(0) for c in ("n", "wins", "losses", "break_even", "max_drawdown_length", "max_wins", "max_losses")} | {c: F.lit(0.0) for c in ("gross_profit", "gross_loss", "net_profit", "max_drawdown", "max_drawdown_pct")} | {"p_value": F.lit(1.0)}
    full = base.join(out, "__all", "left")
    return full.select(*(F.coalesce(F.col(c), zero[c].cast(out.schema[c].dataType)).alias(c) if c in zero else F.col(c) for c in METRICS))
