"""The feature and entry plugins that come with the library, and plugins described by manifests."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import LabError, PluginError
from ..model import Instrument, is_variable_key
from ..operators import bars as bar_ops, features, rules
from .plugins import Plugin, Plugins

#: Bars that a run lets pass before the first signal, whatever its plugins ask for (fixed value).
LEAST_WARMUP = 250


def keys_of(namespace: str, names: str) -> tuple[str, ...]:
    return tuple(f"{namespace}.{n}" for n in names.split())


#: Variables of the feature plugins, by namespace (fixed values); those of time are the entry's own, see features.time_features.
VARIABLES = {
    "candle": "range body upperWick lowerWick bodyRatio upperWickRatio lowerWickRatio isBullish consecutiveBullish consecutiveBearish avgRange5",
    "volatility": "atr atrSlow atrRegime atrPercent range5 range15 range60",
    "trend": "ema20 ema50 ema200 distanceEma20Atr distanceEma200Atr slopeEma20 slopeEma50 slopeEma200 alignment",
    "vwap": "value distance distanceAtr side",
    "market": "dailyOpen gapPoints gapAtr distanceToOpenAtr prevDayHigh prevDayLow prevDayClose prevDayRange distanceToPrevHighAtr distanceToPrevLowAtr dayRangeUsed volume relativeVolume",
    "nas100": "minutesSinceOpen openingRangeHigh openingRangeLow openingRangeSizeAtr openingRangeComplete impulseDirection impulseSizeAtr breakoutSide minutesSinceBreakout "
    "excursionWithImpulseAtr excursionAgainstImpulseAtr pullbackFromExtremeAtr pullbackFraction crossedBackOpen minutesToOpenCross distanceToRangeMidAtr",
}


def builtin_plugins(ins: Instrument, minutes: int = 1) -> Plugins:
    """F2-F7 and E1-E6 for an instrument and a length of bars (F1, the entry's calendar, needs no plugin). Samplers are off
    unless enabled."""
    tz, atr = ins.session_timezone, ("volatility.atr",)
    feature = lambda plugin, space, bundle, requires=(), **more: Plugin(plugin, "1.0.0", "feature", None, keys_of(space, VARIABLES[space]), requires, bundle=bundle, **more)
    own = Plugins()
    for p in (
        feature("core-candle", "candle", features.candle, warmup=5),
        feature("core-volatility", "volatility", features.volatility, config={"fast": 14, "slow": 50}, warmup=50),
        feature("core-trend", "trend", features.trend, atr, config={"lag": 10}, warmup=210),
        feature("core-vwap", "vwap", lambda: features.vwap(tz), atr),
        feature("core-market", "market", lambda: features.market(tz), atr, warmup=60),
        feature("opening-session", "nas100", lambda **k: features.opening(tz, **k), atr, config={"open_minute": ins.open_minute, "range_minutes": 15}),
        Plugin("entry-time-of-day", "1.0.0", "entry", lambda c, **k: rules.time_of_day(c, **k), config={"minute": 570}),
        Plugin("entry-scalp-sampler", "1.0.0", "entry", lambda c, **k: rules.scalp_sampler(c, **k), enabled=False),
        Plugin("entry-opening-range-breakout", "1.0.0", "entry", lambda c, **k: rules.opening_range_breakout(c, **k), config={"minutes": 15, "open_minute": ins.open_minute}),
        Plugin("entry-range-fade", "1.0.0", "entry", lambda c, **k: rules.range_fade(c, **k)),
        Plugin("entry-opening-reversal", "1.0.0", "entry", lambda c, **k: rules.opening_reversal(c, tz, **k), config={"open_minute": ins.open_minute}, warmup=14),
        Plugin("entry-pivot-scalp", "1.0.0", "entry", lambda c, **k: rules.pivot_scalp(c, bar_ops.daily(c, tz), **k), enabled=False),
    ):
        own.add(p)
    return own


#: Fields of a manifest.
MANIFEST = "id string, name string, version string, kind string, provides array<string>, requires array<string>, warmup int, config map<string,string>"


def parse_manifests(texts: DataFrame, column: str = "value") -> DataFrame:
    """Manifests (JSON texts) as rows, each with ``error``: what is wrong with it, null if nothing is. No
    plugin's code is run to know what it offers."""
    d = texts.withColumn("__m", F.from_json(column, MANIFEST)).select("*", "__m.*").drop("__m")
    bad = F.filter(F.coalesce("provides", F.array().cast("array<string>")), lambda k: ~k.rlike(r"^[a-z][A-Za-z0-9]*\.[a-zA-Z][a-zA-Z0-9_]*$"))
    error = (
        F.when(F.col("id").isNull(), "not a manifest").when(~F.col("id").rlike(r"^[a-z][a-z0-9]*(-[a-z0-9]+)*$"), "bad id")
        .when(~F.coalesce(F.col("version").rlike(r"^\d+\.\d+\.\d+$"), F.lit(False)), "bad version").when(~F.coalesce(F.col("kind").isin("feature", "entry"), F.lit(False)), "bad kind")
        .when((F.col("kind") == "feature") & (F.coalesce(F.size("provides"), F.lit(0)) < 1), "provides nothing").when(F.size(bad) > 0, "bad key")
    )
    return d.withColumn("error", error)


def discover_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """The manifests in a folder of plugin folders."""
    return parse_manifests(spark.read.text(f"{folder.rstrip('/')}/*/plugin.json", wholetext=True))


def installed(manifests: DataFrame, installs: DataFrame) -> DataFrame:
    """Every manifest without an error, with what was set for it: enabled (by default) and its configuration,
    the manifest's under the installed one."""
    i = installs.select("id", F.col("enabled").alias("__on"), F.col("config").alias("__own"))
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce("__own", none)
    base = F.map_filter(F.coalesce("config", none), lambda k, v: ~F.map_contains_key(own, k))
    d = manifests.filter("error IS NULL").join(i, "id", "left")
    return d.withColumn("config", F.map_concat(base, own)).withColumn("enabled", F.coalesce("__on", F.lit(True))).drop("__on", "__own")


def load(plugins: Plugins, manifests: list[Mapping], builders: Mapping[str, Callable[..., DataFrame]], tolerant: bool = True) -> dict[str, str]:
    """Register the manifests whose code is at hand (``builders``, by id). What fails is reported by id, or, if
    not tolerant, raised; a disabled plugin's code is not looked for."""
    failed: dict[str, str] = {}
    for m in sorted(manifests, key=lambda m: m["id"]):
        try:
            on = m.get("enabled", True)
            if on and m["id"] not in builders:
                raise PluginError(f"{m['id']} has no code")
            build = builders[m["id"]] if on else (lambda b, **k: b)
            plugins.add(Plugin(m["id"], m["version"], m["kind"], build, tuple(m.get("provides") or ()), tuple(m.get("requires") or ()), dict(m.get("config") or {}), on, int(m.get("warmup") or 0)))
        except LabError as error:
            if not tolerant:
                raise
            failed[m["id"]] = str(error)
    return failed


def feature_json(columns: Mapping[str, Column]) -> Column:
    """Features as a JSON object by variable; values that are not finite are null."""
    for key in columns:
        if not is_variable_key(key):
            raise PluginError(f"bad key {key}")
    finite = lambda c: F.when(F.abs(c.cast("double")) < float("inf"), c.cast("double"))
    return F.to_json(F.struct(*(finite(c).alias(k) for k, c in columns.items())), {"ignoreNullFields": "false"})
