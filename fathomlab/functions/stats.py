"""Statistics as columns where they have a closed form, and vectorised functions where not."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import settle

#: The 97.5 % quantile of the normal distribution (fixed value).
Z95 = 1.959963984540054


def wilson(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval, clamped to [0, 1]; (0, 1) without trials."""
    n = F.nullif(trials.cast("double"), F.lit(0.0))
    p = successes.cast("double") / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    empty = trials == 0
    return (
        F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)),
        F.when(empty, 1.0).otherwise(F.least(F.lit(1.0), centre + half)),
    )


def student_t_upper(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) of Student's distribution, by the continued fraction of the incomplete beta function, for
    whole arrays at once; 1 where t is not a number or there are no degrees of freedom."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.ones(t.shape)
    out[np.isposinf(t) & (df > 0)] = 0.0
    fine = np.isfinite(t) & (df > 0)
    if fine.any():
        a, d = t[fine], df[fine]
        tail = 0.5 * regularised_beta(d / (d + a * a), d / 2, 0.5)
        out[fine] = np.where(a >= 0, tail, 1 - tail)
    return out


_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def regularised_beta(x, a, b):
    """I_x(a, b), of numbers or arrays."""
    shape = np.broadcast(x, a, b).shape
    x, a, b = (np.array(np.broadcast_to(v, shape), float).reshape(-1) for v in (x, a, b))
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    log_front = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(inner) + b * np.log1p(-inner)
    value = np.exp(log_front) / a * _fraction(inner, a, b)
    value = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))
    value = np.where(swap, 1 - value, value).reshape(shape)
    return float(value) if shape == () else value


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Modified Lentz evaluation of the beta continued fraction."""
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones(len(x)), 1 / safe(1 - (a + b) * x / (a + 1))
    f = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / safe(1 + step * d)
            c = safe(1 + step / c)
            f *= c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return f


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def binomial_upper_tail(successes: int, trials: int, p: float) -> float:
    """P(X >= successes); exact up to 20,000 trials, beyond by the normal law with continuity correction."""
    if successes <= 0:
        return 1.0
    if successes > trials:
        return 0.0
    if p <= 0 or p >= 1:
        return float(p >= 1)
    if trials > 20_000:
        return 1 - normal_cdf((successes - 0.5 - trials * p) / math.sqrt(trials * p * (1 - p)))
    logs = [math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + k * math.log(p) + (trials - k) * math.log1p(-p) for k in range(successes, trials + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """One-sided p-value of a t statistic (aggregated rows only)."""
    return pd.Series(student_t_upper(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)))


def t_statistic(n: Column, mean: Column, sd: Column) -> Column:
    """Of the mean against 0: undefined below two values, infinite without spread and above 0."""
    return F.when(n >= 2, F.when(sd > 0, mean / (sd / F.sqrt(n.cast("double")))).when(mean > 0, F.lit(math.inf)).otherwise(0.0))


#: Ranges of p-values that are ranked apart.
RANGES = 32
#: So many different p-values are one range.
ONE_RANGE = 50_000


def benjamini_hochberg(df: DataFrame, p: str, q: str = "q", by: list[str] | None = None) -> DataFrame:
    """q = min over equal or larger p of p * n / rank, capped at 1; null p have null q. Distinct p-values are
    counted, cut into RANGES ranges and ordered inside these; what a range hands on (how many p lie before it,
    the least value after it) is one row. Use ``by`` for separate families."""
    by = by or []
    df = settle(df)
    counts = settle(df.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("__m")))
    many = counts.count() > ONE_RANGE
    cuts = sorted(set(counts.approxQuantile(p, [k / RANGES for k in range(1, RANGES)], 0.01))) if many else []
    place = F.lit(0)
    for k, cut in enumerate(cuts, 1):
        place = F.when(F.col(p) > cut, k).otherwise(place)
    inside = [*by, "__range"]
    ranked = counts.withColumn("__range", place).withColumn("__up", F.sum("__m").over(Window.partitionBy(*inside).orderBy(F.col(p).asc())))
    order = Window.partitionBy(*by).orderBy("__range")
    totals = ranked.groupBy(*inside).agg(F.sum("__m").alias("__t"))
    totals = totals.withColumn("__before", F.coalesce(F.sum("__t").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__n", F.sum("__t").over(Window.partitionBy(*by)))
    raw = _same(ranked, totals, inside).withColumn("__raw", F.col(p) * F.col("__n") / (F.col("__before") + F.col("__up")))
    least = raw.groupBy(*inside).agg(F.min("__raw").alias("__least")).withColumn("__after", F.min("__least").over(order.rowsBetween(1, Window.unboundedFollowing)))
    down = Window.partitionBy(*inside).orderBy(F.col(p).desc())
    qs = _same(raw, least, inside).withColumn(q, F.least(F.lit(1.0), F.min("__raw").over(down), "__after")).select(*by, p, q)
    return _same(df, qs, [*by, p])


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on equal keys, null equal to null; of ``right`` only the other columns are added."""
    renamed = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, condition, "left").drop(*(f"__r_{k}" for k in keys))


def bonferroni(p: Column, n: Column | int) -> Column:
    return F.least(F.lit(1.0), p * F.greatest(F.lit(1), n if isinstance(n, Column) else F.lit(n)))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are known; null below two rows or without spread. The
    aggregate updates centred moments, so large values keep their digits."""
    a, b = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    known = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    return F.when((known >= 2) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.nanvl(F.corr(a, b), F.lit(None).cast("double")))


def normal_quantile(p: float) -> float:
    """The value that a standard normal variable stays below with probability p."""
    if not 0 < p < 1:
        return math.nan if not 0 <= p <= 1 else math.copysign(math.inf, p - 0.5)
    return NormalDist().inv_cdf(p)


def gaussians(uniform: Iterator[float]) -> Iterator[float]:
    """Standard normal values from uniform ones, in pairs by the polar method."""
    while True:
        a, b = 2 * next(uniform) - 1, 2 * next(uniform) - 1
        r = a * a + b * b
        if 0 < r < 1:
            scale = math.sqrt(-2 * math.log(r) / r)
            yield a * scale
            yield b * scale


def _poisson(draws: int, seed: int, key: np.ndarray) -> np.ndarray:
    """Poisson(1) counts (rows x draws) from a hash of row and draw."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(1, draws + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x2545F491)) * np.uint64(0xD1B54A32D192ED03)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        u = ((z ^ (z >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(steps, u).astype(np.float64)


#: Statistics of a bootstrap: parts of a row that are added up, and what follows from the sums.
STATISTICS = {
    "mean": (lambda v: [np.ones(len(v)), v], lambda n, s: s / n),
    "profit_factor": (lambda v: [np.maximum(-v, 0), np.maximum(v, 0)], lambda loss, gain: gain / loss),
    "win_rate": (lambda v: [(v != 0).astype(float), (v > 0).astype(float)], lambda n, s: s / n),
}


def poisson_bootstrap(df: DataFrame, value: str, key: list[str], draws: int = 2000, seed: int = 42, level: float = 0.95, by: list[str] | None = None, statistic: str = "mean") -> DataFrame:
    """Percentile interval of a statistic by a Poisson bootstrap: each row counts Poisson(1) times in each
    draw, by a hash of its ``key`` and the draw. A task adds up its rows into one array of ``draws`` sums for
    each group, and only these arrays are shuffled. Draws in which the statistic is undefined do not count."""
    by = by or ["__all"]
    rows = df.withColumn("__all", F.lit(1)) if by == ["__all"] else df
    rows = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"), F.xxhash64(*key).alias("__k"))
    parts, finish = STATISTICS[statistic]
    kinds = [T.StructField(c, rows.schema[c].dataType) for c in by]
    sums = T.StructType([*kinds, T.StructField("__draw", T.IntegerType()), T.StructField("__a", T.DoubleType()), T.StructField("__b", T.DoubleType())])

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for group, part in frame.groupby(by, dropna=False, sort=False):
                own = total.setdefault(group, np.zeros((2, draws)))
                for k in range(0, len(part), 1024):
                    piece = part.iloc[k : k + 1024]
                    own += np.stack(parts(piece["__v"].to_numpy(float))) @ _poisson(draws, seed, piece["__k"].to_numpy().view(np.uint64))
        for group, (a, b) in total.items():
            yield pd.DataFrame({**{c: [g] * draws for c, g in zip(by, group)}, "__draw": np.arange(draws, dtype=np.int32), "__a": a, "__b": b})

    @F.pandas_udf(T.DoubleType())
    def finished(a: pd.Series, b: pd.Series) -> pd.Series:
        with np.errstate(divide="ignore", invalid="ignore"):
            return pd.Series(finish(a.to_numpy(float), b.to_numpy(float))).replace([np.inf, -np.inf], np.nan)

    drawn = rows.mapInPandas(add, sums).groupBy(*by, "__draw").agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    drawn = drawn.select(*by, F.nanvl(finished("__a", "__b"), F.lit(None).cast("double")).alias("__s"))
    tail = (1 - level) / 2
    out = drawn.groupBy(*by).agg(F.percentile("__s", F.lit(tail)).alias("lower"), F.percentile("__s", F.lit(1 - tail)).alias("upper"))
    return out.drop("__all")
