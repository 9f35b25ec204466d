"""Marginal analysis: one variable at a time, bucketed, ranked by the best bucket's corrected p-value."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..functions.stats import benjamini_hochberg, guarded_corr
from ..model import Variable
from ..plans.guards import Registry
from ..session import settle
from .metrics import ratios, sums
from .ordered import matched
from .quantiles import group_quantiles

#: Defaults (fixed values).
MAX_CATEGORIES, MIN_COUNT, MAX_EDGES = 24, 30, 500
NULL_LABEL = "sin valor"


def edges_of(df: DataFrame, variables: list[Variable], registry: Registry) -> dict[str, list[float]]:
    """Bucket edges of all ranged variables: given, every width, or quantiles (linear between ranks, strictly increasing),
    exact by rounds of counts for all variables together. The result is a few numbers per variable."""
    ranged = [v for v in variables if not v.categorical and v.binning.kind in ("quantile", "width")]
    wide = [(k, registry.column(v.key)) for k, v in enumerate(ranged) if v.binning.kind == "width"]
    row = df.agg(*(f(c).alias(f"{x}{k}") for k, c in wide for x, f in (("a", F.min), ("z", F.max)))).first() if wide else None
    probs = {v.key: [i / v.binning.count for i in range(1, v.binning.count)] for v in ranged if v.binning.kind == "quantile"}
    quantiles: dict[str, list[float]] = {}
    if probs:
        pairs = [F.struct(F.lit(k).alias("variable"), registry.column(k).cast("double").alias("x")) for k in probs]
        long = settle(df.select(F.explode(F.array(*pairs)).alias("v")).select("v.variable", "v.x"))
        quantiles = {r["variable"]: r["q"] for r in group_quantiles(long, ["variable"], "x", probs, by="variable").collect()}
    out: dict[str, list[float]] = {v.key: list(v.binning.edges) for v in variables if v.binning.kind == "edges"}
    for k, v in enumerate(ranged):
        if v.binning.kind == "quantile":
            found: list[float] = []
            for e in quantiles.get(v.key) or []:
                if not found or e > found[-1]:
                    found.append(e)
            out[v.key] = found
        else:
            low, high, w, o = row[f"a{k}"], row[f"z{k}"], v.binning.width, v.binning.origin
            n = int((low - o) // w) + 1 if low is not None else 0
            found = []
            while low is not None and o + n * w <= high and len(found) < MAX_EDGES:
                if o + n * w > low:
                    found.append(o + n * w)
                n += 1
            out[v.key] = found
    return out


def distinct_values(df: DataFrame, keys: list[str], registry: Registry, limit: int = MAX_CATEGORIES) -> DataFrame:
    """variable, values: its distinct values in order, or null if there are more than ``limit``. A sketch of
    fixed size settles which variables have few; only those are listed."""
    counted = df.agg(*(F.approx_count_distinct(registry.column(k), 0.02).alias(f"n{i}") for i, k in enumerate(keys))).first()
    few = [k for i, k in enumerate(keys) if counted[i] <= 2 * limit]
    lists = [F.slice(F.sort_array(F.collect_set(registry.column(k))), 1, limit + 1) for k in few]
    pairs = [F.struct(F.lit(k).alias("variable"), F.when(F.size(x) <= limit, x).alias("values")) for k, x in zip(few, lists)]
    pairs += [F.struct(F.lit(k).alias("variable"), F.lit(None).cast("array<double>").alias("values")) for k in keys if k not in few]
    return df.agg(F.array(*pairs).alias("__p")).select(F.explode("__p").alias("__p")).select("__p.*")


def effective(df: DataFrame, keys: list[str], registry: Registry) -> Registry:
    """``registry`` with categories that have more than MAX_CATEGORIES values, or none, as continuous variables."""
    categories = [k for k in keys if registry[k].categorical]
    if not categories:
        return registry
    wide = [r["variable"] for r in distinct_values(df, categories, registry).filter("values IS NULL OR size(values) = 0").collect()]
    return Registry({**registry, **{k: replace(registry[k], value_type="continuous") for k in wide}}) if wide else registry


def analyze_variable(df: DataFrame, key: str, registry: Registry, pnl: str = "pnl_cents") -> DataFrame:
    """Buckets of one variable."""
    return buckets(df, [key], registry, pnl)


def bucket(c: Column, edges: list[float] | None) -> Column:
    """Number of the range [e_k, e_k+1) that holds a value; the value itself if it is a category."""
    if edges is None:
        return c
    place = F.lit(0.0)
    for k, e in enumerate(edges, start=1):
        place = F.when(c >= F.lit(e), float(k)).otherwise(place)
    return F.when(c.isNotNull(), place)


def bucketed(df: DataFrame, keys: list[str], registry: Registry, keep: list[str]) -> DataFrame:
    """Long form: one row per observation and variable, with its bucket (null: no value). A category with too many values, or
    without any, is cut into ranges like a continuous variable."""
    registry = effective(df, keys, registry)
    variables = [registry[k] for k in keys]
    edges = edges_of(df, variables, registry)
    pairs = [F.struct(F.lit(v.key).alias("variable"), bucket(registry.column(v.key), None if v.categorical else edges.get(v.key, [])).alias("bucket")) for v in variables]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("__b")).select(*keep, "__b.variable", "__b.bucket")


def buckets(df: DataFrame, keys: list[str], registry: Registry, pnl: str = "pnl_cents", quantiles: bool = True) -> DataFrame:
    """Metrics of every bucket of every variable in one grouping, and lift over the population; quantiles only where they are
    asked for."""
    by = ["variable", "bucket"]
    base = Observation()
    used = dict.fromkeys([pnl, *(registry[k].column for k in keys)])
    rows = settle(df.observe(base, F.avg(F.col(pnl).cast("double")).alias("mean")).select(*used))  # read for edges and for buckets
    long = settle(bucketed(rows, keys, registry, [pnl]))
    found = long.groupBy(*by).agg(*sums(pnl))
    if quantiles:
        found = matched(found, group_quantiles(long, by, pnl, [0.05, 0.5, 0.95], "__q"), by, "left")
    return ratios(found).withColumn("lift", F.col("expectancy") - F.lit(base.get["mean"]).cast("double"))


def correlations(df: DataFrame, keys: list[str], registry: Registry, pnl: str = "pnl_cents") -> DataFrame:
    """Pearson correlation of each variable with the outcome, over rows that have a value."""
    pairs = [F.struct(F.lit(k).alias("variable"), registry.column(k).alias("x")) for k in keys]
    long = df.select(F.col(pnl).cast("double").alias("y"), F.explode(F.array(*pairs)).alias("v")).select("y", "v.variable", "v.x")
    return long.groupBy("variable").agg(F.count("x").alias("n"), guarded_corr(F.col("x"), F.col("y")).alias("correlation"))


def rank_variables(df: DataFrame, keys: list[str], registry: Registry, min_count: int = MIN_COUNT) -> DataFrame:
    """The best bucket of each variable (highest expectancy with min_count rows; not the null bucket;
    of equals the first), corrected over variables, ordered by q and then lift."""
    found = buckets(df, keys, registry, quantiles=False).filter((F.col("n") >= min_count) & F.col("bucket").isNotNull())
    w = Window.partitionBy("variable").orderBy(F.col("expectancy").desc(), F.col("bucket").asc())
    best = found.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return benjamini_hochberg(best, "p_value", "q_value").orderBy(F.col("q_value").asc(), F.col("lift").desc_nulls_last())
