"""Order-dependent computations without a task per group.

Rows of a group are cut into at most CHUNKS slices of time. Windows run inside (group, slice); what a
slice hands on (its row count, its sum, its greatest running sum ...) is one small row, and the carry
into a slice is a window over these rows only. So a single group of any size spreads over CHUNKS tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle

CHUNKS = 64


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sliced(df: DataFrame, ts: str, chunks: int = CHUNKS, bounds: tuple[int | None, int | None] | None = None) -> DataFrame:
    """``df`` with ``__chunk``: slices of equal length of the whole range of ``ts``, whose ``bounds`` (in microseconds) are
    looked up unless they are given."""
    low, high = bounds or df.agg(F.min(micros(ts)), F.max(micros(ts))).first()
    if low is None or low == high:
        return df.withColumn("__chunk", F.lit(0).cast("long"))
    width = (high - low) // chunks + 1
    return df.withColumn("__chunk", F.floor((micros(ts) - F.lit(low)) / F.lit(width)).cast("long"))


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on equal keys, null equal to null; of ``right`` only the other columns are added."""
    renamed = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(F.broadcast(renamed) if small else renamed, condition, how).drop(*(f"__r_{k}" for k in keys))


def by_chunk(groups: list[str], order: list[str]):
    return Window.partitionBy(*groups, "__chunk").orderBy(*order)


def carried(df: DataFrame, groups: list[str], **parts: tuple[Column, str, Column]) -> DataFrame:
    """Add a carry-in per slice: name = (aggregate of a slice, how carries combine: sum or max, default
    without an earlier slice)."""
    per = df.groupBy(*groups, "__chunk").agg(*(agg.alias(name) for name, (agg, _, _) in parts.items()))
    before = Window.partitionBy(*groups).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    combine = {"sum": F.sum, "max": F.max}
    per = per.select(*groups, "__chunk", *(F.coalesce(combine[how](name).over(before), default).alias(name) for name, (_, how, default) in parts.items()))
    return matched(df, per, [*groups, "__chunk"], "left")


def placed(df: DataFrame, groups: list[str], ts: str = "ts") -> DataFrame:
    """``df`` with ``__chunk`` and ``__at``, the place of each row in its group, from 1."""
    if "__at" in df.columns:
        return df
    cut = df if "__chunk" in df.columns else sliced(df, ts)
    d = carried(cut.withColumn("__i", F.row_number().over(by_chunk(groups, [ts]))), groups, __n=(F.count("*"), "sum", F.lit(0)))
    return d.withColumn("__at", F.col("__n") + F.col("__i")).drop("__n", "__i")


def walked(df: DataFrame, groups: list[str], ts: str = "entry_ts", tie: str = "id", pnl: str = "pnl_cents") -> DataFrame:
    """``df`` with ``i`` (0-based place in its group), ``equity`` (running sum), ``peak`` (running maximum of it, at least 0) and
    ``run`` (number of the run of outcomes of one sign), in the order of (ts, tie). Each slice is walked by itself; all
    that it hands on is one row, from which the carries into the next ones follow."""
    cut = df if "__chunk" in df.columns else sliced(df, ts)
    w = by_chunk(groups, [ts, tie])
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sign = F.signum(F.col(pnl).cast("double"))
    d = settle(cut.withColumns({"__i": F.row_number().over(w), "__e": F.sum(pnl).over(up), "__turn": F.coalesce((sign != F.lag(sign).over(w)).cast("int"), F.lit(0))}).withColumns({"__m": F.max("__e").over(up), "__run": F.sum("__turn").over(up)}))
    at = F.struct(ts, tie)
    per = d.groupBy(*groups, "__chunk").agg(
        F.count("*").alias("__n"), F.sum(pnl).alias("__s"), F.max("__e").alias("__top"), F.min_by(sign, at).alias("__a"), F.max_by(sign, at).alias("__z"), F.max("__run").alias("__t")
    )
    order = Window.partitionBy(*groups).orderBy("__chunk")  # CHUNKS rows at most
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"__n0": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__s0": F.coalesce(F.sum("__s").over(before), F.lit(0)), "__new": F.coalesce((F.col("__a") != F.lag("__z").over(order)).cast("int"), F.lit(0))})
    per = per.withColumns({"__p0": F.coalesce(F.max(F.col("__s0") + F.col("__top")).over(before), F.lit(0)), "__t0": F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("__t").over(before), F.lit(0))})
    d = matched(d, per.select(*groups, "__chunk", "__n0", "__s0", "__p0", "__t0"), [*groups, "__chunk"])
    zero = F.lit(0).cast(per.schema["__s"].dataType)
    return d.withColumns({
        "i": F.col("__n0") + F.col("__i") - 1, "equity": F.col("__s0") + F.col("__e"), "peak": F.greatest(zero, "__p0", F.col("__s0") + F.col("__m")), "run": F.col("__t0") + F.col("__run")
    }).drop("__i", "__e", "__turn", "__m", "__run", "__n0", "__s0", "__p0", "__t0")


def equity(df: DataFrame, groups: list[str], ts: str = "entry_ts", tie: str = "id", pnl: str = "pnl_cents") -> DataFrame:
    """As :func:`walked`, without the runs."""
    return walked(df, groups, ts, tie, pnl).drop("run")


def placed(df: DataFrame, groups: list[str], ts: str = "ts") -> DataFrame:
    """``df`` with ``__chunk`` and ``__at``, the place of each row in its group, from 1."""
    if "__at" in df.columns:
        return df
    cut = df if "__chunk" in df.columns else sliced(df, ts)
    d = carried(cut.withColumn("__i", F.row_number().over(by_chunk(groups, [ts]))), groups, __n=(F.count("*"), "sum", F.lit(0)))
    return d.withColumn("__at", F.col("__n") + F.col("__i")).drop("__n", "__i")


def equity(df: DataFrame, groups: list[str], ts: str = "entry_ts", tie: str = "id", pnl: str = "pnl_cents") -> DataFrame:
    """``df`` with ``i`` (0-based place in its group), ``equity`` (running sum) and ``peak`` (running
    maximum of it, at least 0), in the order of (ts, tie)."""
    cut = df if "__chunk" in df.columns else sliced(df, ts)
    w = by_chunk(groups, [ts, tie])
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = cut.withColumn("__i", F.row_number().over(w)).withColumn("__e", F.sum(pnl).over(up))
    d = carried(d, groups, __n=(F.count("*"), "sum", F.lit(0)), __s=(F.sum(pnl), "sum", F.lit(0)))
    d = d.withColumn("i", F.col("__n") + F.col("__i") - 1).withColumn("equity", F.col("__s") + F.col("__e"))
    d = d.withColumn("__m", F.max("equity").over(up))
    d = carried(d, groups, __p=(F.max("equity"), "max", F.lit(0)))
    zero = F.lit(0).cast(d.schema["equity"].dataType)
    return d.withColumn("peak", F.greatest(zero, "__p", "__m")).drop("__i", "__e", "__n", "__s", "__m", "__p")


def moving(df: DataFrame, back: int, build: Callable[[DataFrame], DataFrame], ahead: int = 0, key: str = "instrument", ts: str = "ts") -> DataFrame:
    """``build(df)`` for windows over at most ``back`` earlier and ``ahead`` later rows of a key, without a task per
    key. Rows are cut into slices of time, each slice borrows the rows next to it that its windows reach, and
    ``build`` sees key and slice together in the column ``key``; borrowed rows are dropped from what it returns.
    ``build`` keeps the columns that it is given. Rows that are placed already (:func:`placed`) are not numbered again."""
    d = placed(df, [key], ts)
    sizes = d.groupBy(key, "__chunk").agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"))
    spans = sizes.groupBy(key).agg(F.collect_list(F.struct("__chunk", "__first", "__last")).alias("__spans"))  # CHUNKS of a key at most
    d = matched(d, spans, [key])
    reached = F.filter(
        "__spans", lambda s: ((s["__chunk"] > F.col("__chunk")) & (s["__first"] <= F.col("__at") + back)) | ((s["__chunk"] < F.col("__chunk")) & (s["__last"] >= F.col("__at") - ahead))
    )
    targets = F.concat(F.array("__chunk"), F.transform(reached, lambda s: s["__chunk"]))
    d = d.withColumn("__to", F.explode(targets)).withColumn("__borrowed", F.col("__to") != F.col("__chunk"))
    d = d.withColumn(key, F.struct(F.col(key).alias("name"), F.col("__to").alias("slice"))).select(*df.columns, "__borrowed")
    return build(d).filter(~F.col("__borrowed")).drop("__borrowed").withColumn(key, F.col(f"{key}.name"))


def next_at(wanted: DataFrame, series: DataFrame, key: str, at: str, ts: str, found: str) -> DataFrame:
    """``wanted`` with ``found``: the first ``ts`` of ``series`` at or after its time ``at``, null if there is none. Both are
    stacked and looked through backwards inside slices of time; where a slice has none left, the head of a later one
    counts."""
    a = wanted.select(key, F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.struct(*wanted.columns).alias("__row"))
    b = series.select(key, F.col(ts).alias("__t"), F.lit(0).alias("__kind"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"))
    d = sliced(a.unionByName(b), "__t").withColumn("__seen", F.when(F.col("__kind") == 0, F.col("__t")))
    later = Window.partitionBy(key, "__chunk").orderBy(F.col("__t").desc(), "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__here", F.min("__seen").over(later))
    heads = d.groupBy(key, "__chunk").agg(F.min("__seen").alias("__head"))
    after = Window.partitionBy(key).orderBy(F.col("__chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(key, "__chunk", F.min("__head").over(after).alias("__beyond"))  # CHUNKS of a key at most
    d = matched(d.filter("__kind = 1"), heads, [key, "__chunk"], "left")
    return d.select(*(F.col(f"__row.{c}").alias(c) for c in wanted.columns), F.coalesce("__here", "__beyond").alias(found))
