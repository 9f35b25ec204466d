"""A research run: bars to trades. Feature plugins in the order of what they need, entry plugins by id, the path
of every position, and one row per trade with the features known at its entry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.calendar import parts, session_code
from ..model import Instrument
from ..plans.builtin import LEAST_WARMUP, feature_json
from ..plans.plugins import Plugins, rule_id
from ..session import settle
from . import features, rules
from .simulate import simulate


def _column(key: str) -> str:
    return key.replace(".", "_", 1)


def _probe(bundle: features.Bundle, rows: DataFrame) -> DataFrame:
    """``rows`` (none, with the columns so far) with the bundle's: raises what its columns have wrong, without a job."""
    d = rows.withColumns(dict(bundle.windows)) if bundle.windows else rows
    d = d.withColumns({name: F.col(value).cast("double") for name, value, _, _ in bundle.averages}) if bundle.averages else d
    for frame in bundle.frames:
        d = frame(d)
    d = d.withColumns(dict(bundle.late)) if bundle.late else d
    for name, column in bundle.columns.items():
        d = d.withColumn(name, column)
    return d


def feature_rows(bars: DataFrame, plugins: Plugins, overrides: dict[str, dict] | None = None, failed: dict[str, str] | None = None) -> DataFrame:
    """Each bar with the bar that follows it and the columns of all enabled feature plugins (``a.b`` as ``a_b``).

    Plugins that give bundles share one pass. A plugin that only has a function from bars to bars runs on what that pass
    gives, by itself, and its variables are joined. A plugin that fails, when it is set up or while it runs, leaves its
    variables null; ``failed`` gets its id and the error."""
    overrides, failed, bundles, single = overrides or {}, {} if failed is None else failed, [], []
    known = bars.sparkSession.createDataFrame([], placed_schema(bars))
    for p in plugins.ordered("feature"):
        config = {**p.config, **overrides.get(p.id, {})}
        if p.bundle is None:
            single.append((p, config))
            continue
        try:
            bundle = p.bundle(**config)
            tried = _probe(bundle, known)
            tried.select(*(_column(k) for k in p.provides))
            known = tried
        except Exception as error:
            failed[p.id] = str(error).splitlines()[0]
            bundle = features.Bundle(columns={_column(k): F.lit(None).cast("double") for k in p.provides})
            known = known.withColumns(dict(bundle.columns))
        bundles.append(bundle)
    rows = features.together(bars, *bundles, entries=True)
    for p, config in single:
        try:
            own = settle(p.build(rows, **config).select("instrument", "ts", *(F.col(_column(k)).cast("double").alias(_column(k)) for k in p.provides)))
            rows = rows.join(own, ["instrument", "ts"], "left")
        except Exception as error:
            failed[p.id] = str(error).splitlines()[0]
            rows = rows.withColumns({_column(k): F.lit(None).cast("double") for k in p.provides})
    return rows


def placed_schema(bars: DataFrame) -> StructType:
    return StructType([*bars.schema, StructField("__chunk", LongType()), StructField("__at", LongType())])


def signals(bars: DataFrame, plugins: Plugins, minutes: int, ins: Instrument, overrides: dict[str, dict]) -> DataFrame:
    """What the enabled entry plugins give, by rule and configuration."""
    c = rules.closed(bars, minutes, ins.session_timezone)
    found = []
    for p in plugins.ordered("entry"):
        config = {**p.config, **overrides.get(p.id, {})}
        found.append(p.build(c, **config).withColumn("rule_id", F.lit(rule_id(p, config))))
    return reduce(DataFrame.unionByName, found)


def run(bars: DataFrame, plugins: Plugins, ins: Instrument, minutes: int = 1, warmup: int = LEAST_WARMUP, batch: str = "", source: str = "", failed: dict[str, str] | None = None, **overrides: dict) -> DataFrame:
    """Trade rows of a run. No rule speaks before its instrument has ``warmup`` bars, or as many as the plugin that
    asks for most. A failing feature plugin does not end the run, see :func:`feature_rows`."""
    used = [p for kind in ("feature", "entry") for p in plugins.ordered(kind)]
    first = max([warmup, *(p.warmup for p in used)])
    at = features.time_features(F.col("entry_ts"), ins)
    keys = {k.replace("time_", "time.", 1): c for k, c in at.items()}
    keys |= {k: F.col(_column(k)) for p in plugins.ordered("feature") for k in p.provides}
    known = feature_rows(bars, plugins, overrides, failed).filter((F.col("__at") > first) & F.col("entry_ts").isNotNull())
    known = known.select("instrument", "ts", "entry_ts", "entry_open", feature_json(keys).alias("features"))
    found = settle(signals(bars, plugins, minutes, ins, overrides).join(known, ["instrument", "ts"]))
    return trade_rows(simulate(found, bars, ins, kept=["features"]), ins, batch, source, plugins.version())


def trade_rows(trades: DataFrame, ins: Instrument, batch: str = "", source: str = "", version: str = "") -> DataFrame:
    """Trades with the calendar of their entry, and where they come from."""
    p = parts(F.col("entry_ts"), ins.session_timezone)
    calendar = ("session_date", "year", "month", "day_of_month", "day_of_week", "minute_of_day", "day_of_year")
    return trades.select("*", *(p[k].alias(k) for k in calendar), session_code(p["minute_of_day"]).alias("session"), F.lit(batch).alias("batch"), F.lit(source).alias("source"), F.lit(version).alias("feature_set"))
