"""Pattern discovery: conjunctions of buckets, level by level.

Level 1 is every bucket of every variable; those with min_trades rows are *candidates*, numbered by variable
and bucket. A node is an ascending list of candidates of different variables. On each level every node that
was kept is extended by every later candidate of another variable; each extension counts in the universe of
the multiplicity correction (an empty one with p = 1), and those with min_trades rows are kept.

Observations are laid out once in slices of SLICE rows: outcomes, and for each candidate a bitmap of the rows that meet it.
A level is one pass over the slices: a node's rows are the AND of its bitmaps, and products of their outcomes with the
bitmaps of all candidates give the sums of all extensions at once. Sums are exact: outcomes and their squares go in
digits of DIGIT bits. A task adds up its slices, so what it sends follows the nodes of the level and not the rows.

Two valves bound the search, in the order of evaluation (by node): before a level is made, the universe grows to
``max_search_space``; and a level keeps ``max_frontier`` nodes, where that is given. What was evaluated up to there counts. The
number of observations limits neither: no node is held with its rows. The nodes of a level go to all tasks as one array
of numbers, bounded by the first valve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..errors import LookaheadError
from ..functions.stats import benjamini_hochberg
from ..plans.guards import Registry
from ..session import settle
from .marginal import bucket, bucketed, edges_of, effective
from .metrics import ratios, summarize, sums

MAX_CONDITIONS, TOP, MAX_SEARCH_SPACE = 3, 20, 2_000_000
#: Rows of a slice, bits of a digit of sums, and sums of nodes and candidates that a task holds.
SLICE, DIGIT, HELD = 1 << 16, 22, 1 << 21
#: Up to so many patterns are looked up in an observation's own row.
FEW_PATTERNS = 500
_NODE = ["node", "n", "net", "win_rate", "profit_factor", "t_stat", "p_value"]


@dataclass
class Found:
    candidates: DataFrame  # variable, bucket, n, net ...: all single conditions
    names: list[tuple[str, float]]  # variable and bucket of each candidate
    evaluated: DataFrame  # node, n, net, win_rate, profit_factor, t_stat, p_value: the whole universe
    lists: DataFrame  # id, entry_ts, outcome, own: candidates of each observation
    min_trades: int
    universe: int  # combinations evaluated, with empty ones
    truncated: bool

    @property
    def level1_survivors(self) -> int:
        return len(self.names)

    @property
    def nodes(self) -> DataFrame:
        """Frequent conjunctions: conditions (array of variable, bucket) beside the columns of ``evaluated``."""
        named = F.array(*(F.struct(F.lit(v).alias("variable"), F.lit(float(b)).alias("bucket")) for v, b in self.names))
        some = self.evaluated.filter((F.col("n") >= self.min_trades) & F.col("node").isNotNull())
        return some.withColumn("conditions", F.transform("node", lambda j: F.element_at(named, j + 1))) if self.names else some.withColumn("conditions", F.lit(None))


def _checked(keys: list[str], registry: Registry) -> None:
    bad = [k for k in keys if k in registry and registry[k].causality != "predictor"]
    if bad:
        raise LookaheadError(f"not predictors: {', '.join(bad)}")


def candidates(df: DataFrame, keys: list[str], registry: Registry, pnl: str = "pnl_cents") -> DataFrame:
    """Level 1: every non-null bucket of every variable."""
    _checked(keys, registry)
    long = bucketed(df, keys, registry, [pnl]).filter("bucket IS NOT NULL")
    return ratios(long.groupBy("variable", "bucket").agg(*sums(pnl))).withColumn("net", F.col("net_profit"))


def discover(
    df: DataFrame, keys: list[str], registry: Registry, max_conditions: int = MAX_CONDITIONS, min_trades: int = 30, pnl: str = "pnl_cents",
    max_search_space: int = MAX_SEARCH_SPACE, max_frontier: int | None = None,
) -> Found:
    """All conjunctions of up to ``max_conditions`` buckets of different variables that the search reaches."""
    registry = effective(df, keys, registry)
    single = settle(candidates(df, keys, registry, pnl))
    level1 = single.select("variable", "bucket", "n").collect()  # buckets of variables, not rows
    names = sorted(((r["variable"], r["bucket"]) for r in level1 if r["n"] >= min_trades), key=lambda x: (keys.index(x[0]), x[1]))
    lists = settle(_lists(df, keys, registry, names, pnl))
    number = F.create_map(*(x for j, (v, b) in enumerate(names) for x in (F.struct(F.lit(v).alias("variable"), F.lit(float(b)).alias("bucket")), F.lit(j)))) if names else None
    node = F.lit(None).cast("int") if number is None else F.try_element_at(number, F.struct("variable", F.col("bucket").cast("double").alias("bucket")))
    evaluated = single.select(F.when(node.isNotNull(), F.array(node)).alias("node"), *_NODE[1:])
    slices = settle(_slices(lists, len(names), pnl)) if max_conditions > 1 and len(names) > 1 else None
    kept, universe, truncated = evaluated.filter("node IS NOT NULL").select("node"), len(level1), False
    for level in range(2, max_conditions + 1):
        if truncated or len(names) < 2 or kept.isEmpty():
            break
        wanted = _extended(kept, [v for v, _ in names])
        size = wanted.count()
        if universe + size > max_search_space:
            wanted, truncated = wanted.orderBy("node").limit(max(0, max_search_space - universe)), True
        wanted = settle(wanted)
        heads = wanted.select(F.slice("node", 1, level - 1).alias("head")).distinct().toArrow().column(0).combine_chunks()  # max_search_space at most
        heads = np.unique(np.asarray(heads.flatten(), np.int32).reshape(-1, level - 1), axis=0)
        counted = settle(ratios(_counted(slices, heads, [v for v, _ in names])).withColumn("net", F.col("net_profit")).select(*_NODE))
        tried = wanted.join(counted, "node", "left").withColumn("p_value", F.coalesce("p_value", F.lit(1.0))).withColumn("n", F.coalesce("n", F.lit(0)))
        tried = settle(tried.select(*_NODE))
        frequent = tried.filter(F.col("n") >= min_trades)
        if max_frontier is not None and frequent.count() >= max_frontier:
            last = F.array(*map(F.lit, frequent.select("node").orderBy("node").limit(max_frontier).agg(F.max("node")).first()[0]))
            truncated = truncated or not tried.filter(F.col("node") > last).isEmpty()
            tried = settle(tried.filter(F.col("node") <= last))
            frequent = tried.filter(F.col("n") >= min_trades)
        kept = settle(frequent.select("node"))
        universe += tried.count()
        evaluated = evaluated.unionByName(tried)
    return Found(single, names, evaluated, lists, min_trades, universe, truncated)


def _lists(df: DataFrame, keys: list[str], registry: Registry, names: list[tuple[str, float]], pnl: str) -> DataFrame:
    """id, entry_ts, outcome and ``own``, the candidates that an observation meets, in order."""
    edges = edges_of(df, [registry[k] for k in keys], registry)
    found = []
    for key in keys:
        mine = [(b, j) for j, (v, b) in enumerate(names) if v == key]
        if mine:
            own = bucket(registry.column(key), None if registry[key].categorical else edges.get(key, [])).cast("double")
            found.append(F.try_element_at(F.create_map(*(F.lit(x) for b, j in mine for x in (float(b), j))), F.coalesce(own, F.lit(float("nan")))))
    own = F.filter(F.array(*found), lambda j: j.isNotNull()) if found else F.array().cast("array<int>")
    return df.filter(F.col(pnl).isNotNull()).select("id", "entry_ts", pnl, F.sort_array(own).alias("own"))


def _slices(lists: DataFrame, count: int, pnl: str) -> DataFrame:
    """rows, outcomes (64-bit integers) and bits (a packed bitmap for each of ``count`` candidates) of slices of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            own, outcome = table.column(1).combine_chunks(), np.asarray(table.column(0)).astype("<i8")
            met = np.zeros((count, table.num_rows), bool)
            ptr = np.asarray(own.offsets)
            met[np.asarray(own.flatten()), np.repeat(np.arange(table.num_rows), np.diff(ptr))] = True
            bits = np.packbits(met, axis=1)
            return pa.RecordBatch.from_arrays(
                [pa.array([table.num_rows], pa.int32()), pa.array([outcome.tobytes()], pa.binary()), pa.array([[x.tobytes() for x in bits]], pa.list_(pa.binary()))], ["rows", "outcomes", "bits"]
            )

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SLICE:
                yield out()
                held.clear()
        if sum(b.num_rows for b in held):
            yield out()

    return lists.select(F.col(pnl).cast("long").alias("outcome"), "own").mapInArrow(run, "rows int, outcomes binary, bits array<binary>")


#: Columns of sums: counts, then digits of gains, of losses, and of the squares of all outcomes and of losses.
_DIGITS = {"gain": 3, "loss": 3, "xx": 3, "down": 3}
_SUMS = ["n", "wins", "losses", *(f"{c}{k}" for c, d in _DIGITS.items() for k in range(d))]


def _measures(outcome: np.ndarray) -> np.ndarray:
    """Of each outcome (below 2 ** 31 in size) the columns _SUMS, in floats that hold their sums over a slice exactly."""
    if len(outcome) and max(abs(int(outcome.min())), int(outcome.max())) >= 1 << 31:
        raise ValueError("an outcome of 2 ** 31 or more")
    digits = lambda x: [((x >> (DIGIT * k)) & ((1 << DIGIT) - 1)).astype(np.float64) for k in range(3)]
    gain, loss = np.maximum(outcome, 0), np.maximum(-outcome, 0)
    return np.column_stack([np.ones(len(outcome)), outcome > 0, outcome < 0, *digits(gain), *digits(loss), *digits(outcome * outcome), *digits(loss * loss)])


def _counted(slices: DataFrame, heads: np.ndarray, variables: list[str]) -> DataFrame:
    """node and its sums, for all extensions of ``heads`` that have rows."""
    number = {v: k for k, v in enumerate(dict.fromkeys(variables))}
    of = np.array([number[v] for v in variables])
    shared = slices.sparkSession.sparkContext.broadcast((heads, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, of = shared.value
        part = max(1, HELD // (len(of) * len(_SUMS)))
        whole = np.zeros((len(nodes), len(of), len(_SUMS)), np.int64) if len(nodes) <= part else None

        def out(begin: int, total: np.ndarray) -> pa.RecordBatch:
            head, more = np.nonzero(total[:, :, 0])
            ids = np.concatenate([nodes[begin + head], more[:, None].astype(np.int32)], axis=1)
            width = ids.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * width, pa.int32()), pa.array(ids.reshape(-1)))
            return pa.RecordBatch.from_arrays([lists, *(pa.array(total[head, more, k]) for k in range(len(_SUMS)))], ["node", *_SUMS])

        for batch in batches:
            for rows, outcomes, bits in zip(*(batch.column(k).to_pylist() for k in range(3))):
                measure = _measures(np.frombuffer(outcomes, "<i8"))
                packed = np.stack([np.frombuffer(x, np.uint8) for x in bits])
                met = np.unpackbits(packed, axis=1, count=rows).T.astype(np.float64)
                for begin in range(0, len(nodes), part):
                    some = nodes[begin : begin + part]
                    total = np.zeros((len(some), len(of), len(_SUMS)), np.int64)
                    for k, node in enumerate(some):
                        at = np.flatnonzero(np.unpackbits(np.bitwise_and.reduce(packed[node], axis=0), count=rows))
                        later = np.flatnonzero((np.arange(len(of)) > node[-1]) & ~np.isin(of, of[node]))
                        if len(at) and len(later):
                            total[k, later] = met[at][:, later].T @ measure[at]
                    if whole is not None:
                        whole += total
                    else:
                        yield out(begin, total)
        if whole is not None:
            yield out(0, whole)

    schema = "node array<int>, " + ", ".join(f"{c} long" for c in _SUMS)
    d = slices.mapInArrow(run, schema).groupBy("node").agg(*(F.sum(c).alias(c) for c in _SUMS))
    whole = lambda c: reduce(lambda x, y: x + y, (F.col(f"{c}{k}").cast("decimal(28,0)") * F.lit(1 << (DIGIT * k)).cast("decimal(20,0)") for k in range(3))).cast("decimal(38,0)")
    return d.select(
        "node", "n", "wins", "losses", (F.col("n") - F.col("wins") - F.col("losses")).alias("break_even"), whole("gain").cast("double").alias("gross_profit"),
        whole("loss").cast("double").alias("gross_loss"), whole("xx").alias("__xx"), whole("down").alias("__down"),
    )


def _extended(kept: DataFrame, variables: list[str]) -> DataFrame:
    """Every kept node with every later candidate of another variable."""
    of = F.array(*map(F.lit, variables))
    last = F.element_at("node", -1)
    more = kept.filter(last < len(variables) - 1).select("node", F.explode(F.sequence(last + 1, F.lit(len(variables) - 1))).alias("k"))
    fresh = ~F.exists("node", lambda j: F.element_at(of, j + 1) == F.element_at(of, F.col("k") + 1))
    return more.filter(fresh).select(F.concat("node", F.array("k")).alias("node"))


def _subsets(items: Column, level: int) -> Column:
    """All ``level``-element subsets of a sorted array, in order."""
    found = F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y: F.array(x, y))))

    def longer(sets: Column, size: int) -> Column:
        return F.flatten(F.transform(sets, lambda p: F.transform(F.filter(items, lambda y: y > F.element_at(p, size)), lambda y: F.concat(p, F.array(y)))))

    for size in range(2, level):
        found = longer(found, size)
    return found


def corrected(found: Found) -> DataFrame:
    """The universe with its q-values."""
    return benjamini_hochberg(found.evaluated, "p_value", "q_value")


def matches(found: Found, min_profit_factor: float | None = None, min_win_rate: float | None = None) -> DataFrame:
    """Frequent nodes that pass the thresholds (an undefined ratio does not), with q-values."""
    d = corrected(found).filter((F.col("n") >= found.min_trades) & F.col("node").isNotNull())
    for name, least in (("win_rate", min_win_rate), ("profit_factor", min_profit_factor)):
        if least is not None:
            d = d.filter(F.col(name) >= least)
    return d


def top(
    found: Found, k: int = TOP, max_q: float = 1.0, min_profit_factor: float | None = None, min_win_rate: float | None = None, max_drawdown_pct: float | None = None, pnl: str = "pnl_cents",
) -> DataFrame:
    """The best k patterns by q, equity R-squared and profit factor, with full metrics. All nodes whose q is not
    above the k-th are looked at in full, so ties are ordered by the later keys; a limit on the drawdown is a
    metric of the path, and with it all matches are."""
    best = settle(matches(found, min_profit_factor, min_win_rate).filter(F.col("q_value") <= max_q).select("node", "q_value"))
    if max_drawdown_pct is None:
        worst = best.orderBy("q_value").limit(k).agg(F.max("q_value")).first()[0]
        best = settle(best.filter(F.col("q_value") <= (1.0 if worst is None else worst)))
    if best.count() <= FEW_PATTERNS:
        listed = [r["node"] for r in best.select("node").collect()]
        listed = F.array(*(F.array(*map(F.lit, node)) for node in listed)) if listed else F.array().cast("array<array<int>>")
        per_level = [found.lists.select("id", "entry_ts", pnl, F.explode(F.filter(listed, lambda node: F.size(F.array_except(node, "own")) == 0)).alias("node"))]
    else:
        depths = [r[0] for r in best.select(F.size("node")).distinct().collect()]
        subsets = lambda d: F.transform("own", lambda j: F.array(j)) if d == 1 else _subsets(F.col("own"), d)
        per_level = [found.lists.select("id", "entry_ts", pnl, F.explode(subsets(d)).alias("node")).join(best.select("node"), "node", "left_semi") for d in sorted(depths)]
    shape = "pattern string, depth int, n long, win_rate double, profit_factor double, equity_r2 double, q_value double"
    if best.isEmpty():
        return best.sparkSession.createDataFrame([], shape)
    full = summarize(reduce(DataFrame.unionByName, per_level), ["node"], pnl=pnl).join(best, "node")
    if max_drawdown_pct is not None:
        full = full.filter(F.col("max_drawdown_pct") <= max_drawdown_pct)
    label = F.array(*(F.lit(f"{v}={b:g}") for v, b in found.names))
    pattern = F.array_join(F.sort_array(F.transform("node", lambda j: F.element_at(label, j + 1))), " and ")
    return (
        full.select(pattern.alias("pattern"), F.size("node").alias("depth"), "n", "win_rate", "profit_factor", "equity_r2", "q_value")
        .orderBy("q_value", F.coalesce("equity_r2", F.lit(-1.0)).desc(), F.col("profit_factor").desc_nulls_last(), "pattern").limit(k)
    )
