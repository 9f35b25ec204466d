"""Exact quantiles of groups by rank selection: rounds of counts in ranges, until few values are left around each rank.

A round cuts the range in which a wanted rank lies into BINS equal parts and counts them, with partial sums on the map side, so
no aggregate holds the different values of a group. The part that holds the rank, between its least and its greatest value, is
the next range. When a range has FEW rows or one value, its rows are listed and the rank is read off. All groups and ranks go
through a round together; a range that several ranks share is counted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .ordered import matched

BINS, FEW = 1024, 4096
#: Ranges that are broadcast to the rows; beyond, rows are shuffled to them.
NEAR = 100_000


def _meets(rows: DataFrame, ranges: DataFrame, groups: list[str], inside: Column) -> DataFrame:
    """Rows with the ranges of their group that hold their value."""
    return matched(rows, ranges, groups, small=ranges.count() <= NEAR).filter(inside)


def group_quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float] | dict[str, list[float]], name: str = "q", by: str | None = None) -> DataFrame:
    """groups, ``name``: array of the quantiles at ``probs`` (linear between ranks), as doubles; groups without a value are left
    out. With ``by``, one of ``groups``, ``probs`` has a list for each of its values. ``df`` is read once a round: settle it
    first, unless it is cheap."""
    rows = df.select(*groups, F.col(value).alias("__v")).filter("__v IS NOT NULL")
    lists = probs if isinstance(probs, dict) else {None: probs}
    asked = None
    for k, p in lists.items():
        listed = F.array(*(F.lit(float(x)) for x in p)).cast("array<double>")
        asked = listed if asked is None and k is None else F.when(F.col(by) == k, listed) if asked is None else asked.when(F.col(by) == k, listed)
    stat = settle(rows.groupBy(*groups).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")))
    places = F.transform(asked, lambda p: (F.col("__n") - 1) * p)
    ranks = F.array_distinct(F.concat(F.transform(places, lambda h: F.floor(h)), F.transform(places, lambda h: F.ceil(h))))
    state = stat.select(*groups, F.explode(ranks).alias("__k"), F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__in"), "__low", "__high")
    window = ["__low", "__high", "__below", "__in"]
    while True:
        open_ = (F.col("__in") > FEW) & (F.col("__low") < F.col("__high"))
        left = state.filter(open_)
        if left.isEmpty():
            break
        part = F.least(F.lit(BINS - 1), F.floor((F.col("__v") - F.col("__low")).cast("double") / (F.col("__high") - F.col("__low")).cast("double") * BINS))
        ranges = settle(left.select(*groups, *window).distinct())
        counts = _meets(rows, ranges, groups, F.col("__v").between(F.col("__low"), F.col("__high"))).groupBy(*groups, *window, part.alias("__part"))
        counts = counts.agg(F.count("*").alias("__m"), F.min("__v").alias("__l"), F.max("__v").alias("__h"))
        up = Window.partitionBy(*groups, *window).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # BINS rows at most
        counts = counts.withColumn("__to", F.col("__below") + F.sum("__m").over(up))
        held = (F.col("__k") < F.col("__to")) & (F.col("__k") >= F.col("__to") - F.col("__m"))
        found = matched(left, counts, [*groups, *window]).filter(held)
        found = found.select(*groups, "__k", (F.col("__to") - F.col("__m")).alias("__below"), F.col("__m").alias("__in"), F.col("__l").alias("__low"), F.col("__h").alias("__high"))
        state = settle(state.filter(~open_).unionByName(found))
    ranges = settle(state.filter("__low < __high").select(*groups, *window).distinct())
    lists = _meets(rows, ranges, groups, F.col("__v").between(F.col("__low"), F.col("__high"))).groupBy(*groups, *window).agg(F.sort_array(F.collect_list("__v")).alias("__list"))  # FEW at most
    state = matched(state, lists, [*groups, *window], "left")
    read = F.coalesce(F.get("__list", (F.col("__k") - F.col("__below")).cast("int")), F.col("__low")).cast("double")
    at = state.select(*groups, "__k", read.alias("__x")).groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("__k", "__x"))).alias("__at"))
    out = matched(stat, at, groups)

    def between(h: Column) -> Column:
        low, high = F.col("__at")[F.floor(h)], F.col("__at")[F.ceil(h)]
        return low + (h - F.floor(h)) * (high - low)

    return out.select(*groups, F.transform(places, between).alias(name))
