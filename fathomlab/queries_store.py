"""Registered queries over files, stored tables, the catalog and streams, with their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from .functions.formatting import integer, num, pct
from .functions.stats import t_p_value
from .model import BAR_SCHEMA
from .operators import bars as bar_ops, catalog, hypotheses, indicators, marginal, research, storage
from .operators.ordered import moving
from .plans.builtin import builtin_plugins, installed, parse_manifests
from .plans.language import parse
from .queries_bars import H1, INSTRUMENT, ORACLE as ORACLE_BARS, SIM, _simulated as simulated
from .queries_cohort import COND, OBS_SQL, TEXT, p_sql
from .session import shared_dir
from .sources.bar_files import read_bars, read_json_bars, write_bars
from .streaming import live_bars
from .sources.views import OBS, TRAIN, VALIDATION, bars_h1, in_split, observations, read

Q, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Files ------------------------------------------------------------------------------------------


@query("s7_bar_files", f"WITH {H1} SELECT instrument, ts, open, high, low, close, tick_volume FROM h")
def bar_files(spark, sf_dir) -> DataFrame:
    """Bars written as text in another zone's wall time, and read back: delimiter, header, zone, numbers."""
    bars, out = bars_h1(spark, sf_dir), None
    for name in [r["instrument"] for r in bars.select("instrument").distinct().collect()]:  # instruments
        path = scratch(spark, "bars")
        write_bars(bars.filter(F.col("instrument") == name), path, "UTC+2")
        found = read_bars(spark, path, name, "H1", "UTC+2").good
        out = found if out is None else out.unionByName(found)
    return out.select("instrument", "ts", "open", "high", "low", "close", "tick_volume")


@query("s8_json_bars", f"""WITH {H1}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) % 10 AS k FROM h),
e AS (SELECT *, CASE WHEN k = 0 THEN 'bad date' WHEN k = 1 THEN 'bad price' WHEN k = 2 THEN 'prices outside low..high' END AS error FROM k)
SELECT error, count(*) AS n, CASE WHEN error IS NULL THEN round(sum(close), 2) END AS total, CASE WHEN error IS NULL THEN max(ts) END AS last_ts FROM e GROUP BY error""")
def json_bars(spark, sf_dir) -> DataFrame:
    """JSON records with times as text, seconds or milliseconds, and wrong ones among them."""
    k = F.row_number().over(Window.partitionBy("instrument").orderBy("ts")) % 10
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    when = F.when(F.col("k") == 0, "none").when(F.col("k") < 4, ms.cast("string")).when(F.col("k") < 7, (ms / 1000).cast("long").cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    record = F.to_json(F.struct(when.alias("time"), F.when(F.col("k") != 1, F.col("open")).alias("open"), "high", F.when(F.col("k") == 2, F.col("high") + 1).otherwise(F.col("low")).alias("low"), "close", F.col("tick_volume").alias("tickVolume")))
    path = scratch(spark, "json-bars")
    bars_h1(spark, sf_dir).withColumn("k", k).select(record.alias("value")).write.text(path)
    found = read_json_bars(spark, path, "all", "H1")
    good = found.good.agg(F.lit(None).cast("string").alias("error"), F.count("*").alias("n"), F.round(F.sum("close"), 2).alias("total"), F.max("ts").alias("last_ts"))
    bad = found.bad.groupBy("error").agg(F.count("*").alias("n"))
    return good.unionByName(bad.select("error", "n", F.lit(None).cast("double").alias("total"), F.lit(None).cast("timestamp_ntz").alias("last_ts")))


@query("k2_import_files", f"""WITH {H1}, one AS (SELECT *, 1 AS line FROM h WHERE instrument = (SELECT min(instrument) FROM h))
SELECT instrument, ts, open, close, count(*) OVER () AS n, (SELECT count(*) FROM one) * 2 + 1 AS n_read, (SELECT count(*) FROM one) AS n_rejected_or_known, 1 AS n_bad, true AS known_again FROM one""")
def import_files(spark, sf_dir) -> DataFrame:
    """A file in which each bar is repeated with other prices, and one line is wrong: the first line of a key stays, the import is
    a batch with its counts, and the same content is recognised the second time."""
    from .operators.catalog import Catalog
    from .sources.bar_files import import_bars

    bars = bars_h1(spark, sf_dir)
    name = bars.agg(F.min("instrument")).first()[0]
    text = lambda shift: F.concat_ws(",", F.date_format("ts", "yyyy.MM.dd"), F.date_format("ts", "HH:mm:ss"), *(F.col(c) + shift for c in ("open", "high", "low", "close")), F.lit("1"), F.lit("0"), F.lit("1"))
    lines = bars.filter(F.col("instrument") == name).select(F.explode(F.array(F.struct(F.lit(0).alias("k"), text(0).alias("line")), F.struct(F.lit(1).alias("k"), text(-50).alias("line")))).alias("x"), "ts").select("x.*", "ts")
    wrong = spark.createDataFrame([(2, "2099.01.01,00:00:00,1,x,1,1,1,0,1")], "k int, line string").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    path, store = scratch(spark, "import-in"), scratch(spark, "import-store")
    lines.unionByName(wrong).repartition(1).sortWithinPartitions("k", F.col("ts").desc()).select("line").write.text(path)
    catalog = Catalog(spark, scratch(spark, "import-catalog"))
    first, again = (import_bars(spark, path, store, name, "H1", catalog=catalog) for _ in range(2))
    counts = [F.lit(v).cast("long" if isinstance(v, int) else "boolean").alias(k) for k, v in {"n_read": first.read, "n_rejected_or_known": first.duplicates, "n_bad": first.rejected}.items()]
    stored = spark.read.parquet(store)
    return stored.select("instrument", "ts", "open", "close", F.lit(first.inserted).cast("long").alias("n"), *counts, F.lit(again.repeated == first.batch).alias("known_again"))


@query("k1_insert_new", f"""WITH {H1} SELECT instrument, ts, close FROM h WHERE hour(ts) >= 12""")
def insert_new(spark, sf_dir) -> DataFrame:
    """An import that repeats stored bars and itself adds only what is not stored."""
    bars = bars_h1(spark, sf_dir).withColumn("timeframe", F.lit("H1"))
    again = bars.withColumn("place", F.lit(1)).unionByName(bars.withColumn("place", F.lit(2)).withColumn("close", F.col("close") + 1))
    new = storage.insert_new(bars.filter(F.hour("ts") < 12), again, ["instrument", "timeframe", "ts"], ["place"])
    return new.select("instrument", "ts", "close")


@query("k4_update_features", "WITH n AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey, round(coalesce(v, c_acctbal), 2) AS c_acctbal FROM customer LEFT JOIN n ON o_custkey = c_custkey")
def update_features(spark, sf_dir) -> DataFrame:
    changes = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    done = storage.update_features(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), changes, "c_custkey", "c_acctbal")
    return done.select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("k6_upsert_preserves", "SELECT c_custkey, round(c_acctbal, 2) AS config, CAST(c_nationkey + 1 AS BIGINT) AS version FROM customer UNION ALL SELECT -o_orderkey, 7.0, CAST(2 AS BIGINT) FROM orders WHERE o_orderkey BETWEEN 1 AND 100")
def upsert_preserves(spark, sf_dir) -> DataFrame:
    """A stored configuration outlives the upsert of a newer version; new keys take what comes."""
    old = read(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("config"), F.col("c_nationkey").cast("long").alias("version"))
    new = old.select("c_custkey", F.lit(-1.0).alias("config"), (F.col("version") + 1).alias("version")).unionByName(
        read(spark, sf_dir, "orders").filter("o_orderkey BETWEEN 1 AND 100").select((-F.col("o_orderkey")).alias("c_custkey"), F.lit(7.0).alias("config"), F.lit(2).cast("long").alias("version")))
    return storage.upsert(old, new, ["c_custkey"], preserve=["config"])


# Catalog ----------------------------------------------------------------------------------------

BATCH_SQL = """b AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS batch, count(*) AS n, min(ts) AS a, max(ts) AS z, 'h' || CAST(dayofmonth(ts) % 5 AS VARCHAR) AS hash, dayofmonth(ts) % 2 = 0 AS done
  FROM events GROUP BY CAST(ts AS DATE), dayofmonth(ts))"""


def _batch_log(spark, sf_dir) -> DataFrame:
    """A log of imports, one a day of the events; those of odd days never finished."""
    day = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    hashed = F.concat(F.lit("h"), F.dayofmonth("d") % 5)
    none = F.lit(None)
    begin = day.select(F.col("d").cast("string").alias("batch"), F.lit("started").alias("event"), F.col("a").alias("at"), F.lit("events").alias("source"), hashed.alias("hash"), none.cast("long").alias("accepted"), none.cast("long").alias("rejected"), none.cast("array<string>").alias("errors"))
    end = day.filter(F.dayofmonth("d") % 2 == 0).select(F.col("d").cast("string").alias("batch"), F.lit("finished").alias("event"), F.col("z").alias("at"), none.cast("string").alias("source"), none.cast("string").alias("hash"), F.col("n").alias("accepted"), F.lit(150).cast("long").alias("rejected"), F.array_repeat(F.lit("bad date"), 150).alias("errors"))
    return begin.unionByName(end)


@query("k7_import_batches", f"WITH {BATCH_SQL} SELECT batch, hash, CASE WHEN done THEN 'finished' ELSE 'running' END AS status, CASE WHEN done THEN n ELSE 0 END AS accepted, CAST(CASE WHEN done THEN 100 ELSE 0 END AS BIGINT) AS errors FROM b")
def import_batches(spark, sf_dir) -> DataFrame:
    return catalog.import_batches(_batch_log(spark, sf_dir)).select("batch", "hash", "status", "accepted", F.size("errors").cast("long").alias("errors"))


@query("k2_batch_by_hash", f"WITH {BATCH_SQL} SELECT hash, arg_max(batch, (z, batch)) AS batch FROM b WHERE done AND hash IN ('h0', 'h1', 'h3') GROUP BY 1")
def batch_by_hash(spark, sf_dir) -> DataFrame:
    asked = spark.createDataFrame([("h0",), ("h1",), ("h3",), ("h9",)], "hash string")
    return catalog.batches_by_hash(_batch_log(spark, sf_dir), asked).select("hash", "batch")


@query("k10_i12_split_uses", "SELECT CAST(o_custkey AS VARCHAR) AS split, count(*) AS evaluations, CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN count(*) > 20 THEN 'hard' WHEN count(*) > 10 THEN 'soft' END AS warning FROM orders GROUP BY o_custkey")
def split_uses(spark, sf_dir) -> DataFrame:
    """A log of evaluations, one an order: how often each split was used, and the warning that earns."""
    log = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("split"), F.when(F.col("o_custkey") % 3 == 0, "training").otherwise("validation").alias("role"))
    return hypotheses.uses(log).select("split", "evaluations", "warning")


@query("k11_hypothesis_status", """WITH s AS (SELECT o_custkey, arg_max(CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'rejected' ELSE 'archived' END, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS hypothesis, c_name AS name, coalesce(status, 'training_passed') AS status FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def hypothesis_status(spark, sf_dir) -> DataFrame:
    created = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("hypothesis"), F.col("c_name").alias("name"))
    status = F.when(F.col("o_orderstatus") == "F", "validated").when(F.col("o_orderstatus") == "O", "rejected").otherwise("archived")
    log = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("hypothesis"), status.alias("status"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"))
    return catalog.hypotheses(created, log).select("hypothesis", "name", "status")


@query("k12_newest_runs", "SELECT o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS hypothesis, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS BIGINT) AS place FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def newest_runs(spark, sf_dir) -> DataFrame:
    log = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("hypothesis"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"))
    top = catalog.validation_runs(log).limit(20)
    return top.select("seq", "hypothesis", F.row_number().over(Window.orderBy(F.col("at").desc(), F.col("seq").desc())).cast("long").alias("place"))


@query("k9_splits", "SELECT * FROM (VALUES ('train', 'training', CAST(0 AS BIGINT)), ('validation', 'validation', CAST(1 AS BIGINT))) t(name, role, place), (SELECT count(*) > 0 AS used FROM orders)")
def stored_splits(spark, sf_dir) -> DataFrame:
    """Splits are created, one is deleted, the others are listed by their start."""
    from dataclasses import replace

    store = catalog.Catalog(spark, scratch(spark, "catalog"))
    for s in (VALIDATION, TRAIN, replace(TRAIN, name="other")):
        store.create_split(s)
    store.delete_split("other")
    used = not read(spark, sf_dir, "orders").isEmpty()
    return spark.createDataFrame([(s.name, s.role, k, used) for k, s in enumerate(store.splits())], "name string, role string, place long, used boolean")


@query("i13_i14_protocol", f"""WITH {OBS_SQL}, t AS (SELECT count(*) FILTER (WHERE pnl_cents > 0) AS w, count(*) FILTER (WHERE pnl_cents <> 0) AS n FROM train WHERE {COND}),
v AS (SELECT count(*) AS c, count(*) FILTER (WHERE pnl_cents > 0) / nullif(count(*) FILTER (WHERE pnl_cents <> 0), 0) AS wr, sum(pnl_cents) / count(*) AS ex FROM validation WHERE {COND}), z AS (SELECT 1.959963984540054 AS z)
SELECT 'many-lines' AS hypothesis, c AS n, CAST(1 AS BIGINT) AS evaluations, CAST(1 AS BIGINT) AS runs,
  CASE WHEN c > 0 AND ex > 0 AND wr >= (w / n + z * z / (2 * n) - z * sqrt(w / n * (1 - w / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n) THEN 'validated' ELSE 'rejected' END AS status FROM t, v, z""")
def protocol(spark, sf_dir) -> DataFrame:
    """Save a hypothesis on the training split and validate it once, through the catalog."""
    store, obs = catalog.Catalog(spark, scratch(spark, "catalog")), observations(spark, sf_dir)
    store.create_split(TRAIN)
    store.create_split(VALIDATION)
    key = store.save("Many lines", parse(TEXT), OBS, obs, store.split("train"))
    r = store.validate(key, store.split("validation"), OBS, obs, store.split("train"), confirmed=True)
    uses = hypotheses.uses(store.log("evaluations")).first()["evaluations"]
    return spark.createDataFrame([(key, r["n"], uses, store.runs(key).count(), store.hypothesis(key)["status"])], "hypothesis string, n long, evaluations long, runs long, status string")


# Listings, categories, numbers ------------------------------------------------------------------


@query("t4_listed_bars", f"WITH {H1} SELECT instrument, ts, close, (SELECT count(*) FROM h) > 3000 AS truncated FROM h ORDER BY ts, instrument LIMIT 3000")
def listed_bars(spark, sf_dir) -> DataFrame:
    return catalog.listed(bars_h1(spark, sf_dir), "bars", F.col("ts"), F.col("instrument")).select("instrument", "ts", "close", "truncated")


@query("g8_distinct_up_to", f"WITH {OBS_SQL} SELECT 'obs.segment' AS variable, CASE WHEN count(DISTINCT f_segment) <= 24 THEN array_to_string(list_sort(list(DISTINCT CAST(f_segment AS INT))), ',') END AS \"values\" FROM obs UNION ALL SELECT 'obs.balance', CASE WHEN count(DISTINCT f_balance) <= 24 THEN '' END FROM obs UNION ALL SELECT 'obs.lines', CASE WHEN count(DISTINCT f_lines) <= 24 THEN array_to_string(list_sort(list(DISTINCT CAST(f_lines AS INT))), ',') END FROM obs")
def distinct_up_to(spark, sf_dir) -> DataFrame:
    """Distinct values of each variable, null for those with more than 24."""
    found = marginal.distinct_values(observations(spark, sf_dir), ["obs.segment", "obs.balance", "obs.lines"], OBS)
    return found.select("variable", F.array_join(F.transform("values", lambda v: v.cast("int").cast("string")), ",").alias("values"))


@query("w9_values_back", f"WITH {H1} SELECT instrument, ts, lag(close, 3) OVER w AS back3, CAST(least(row_number() OVER w, 5) AS BIGINT) AS held FROM h WINDOW w AS (PARTITION BY instrument ORDER BY ts)")
def values_back(spark, sf_dir) -> DataFrame:
    """Of the last five closes that a rule may look at: the one three bars back, and how many there are."""
    buffer = moving(bars_h1(spark, sf_dir), 4, lambda d: indicators.buffered(d, "close", 5))
    return buffer.select("instrument", "ts", indicators.back("buffer", 3).alias("back3"), F.size("buffer").cast("long").alias("held"))


T_SQL = f"""{OBS_SQL}, g AS (SELECT f_year, count(*) AS n, avg(CAST(pnl_cents AS DOUBLE)) AS m, stddev_samp(CAST(pnl_cents AS DOUBLE)) AS sd FROM obs GROUP BY 1),
s AS (SELECT f_year, n - 1 AS v, m / (sd / sqrt(n)) AS t FROM g)"""


@query("m16_t_and_p", f"WITH {T_SQL} SELECT f_year, v AS df, round(t, 6) AS t, round({p_sql('t', 'v')}, 6) AS p FROM s WHERE v > 0")
def t_values(spark, sf_dir) -> DataFrame:
    """t of the mean outcome by year, and its one-sided p."""
    from .operators.metrics import ratios, sums

    d = ratios(observations(spark, sf_dir).groupBy("f_year").agg(*sums())).filter("n > 1")
    return d.select("f_year", (F.col("n") - 1).alias("df"), F.round("t_stat", 6).alias("t"), (F.round("p_value", 6) + 0.0).alias("p"))


@query("m16_small_samples", f"""WITH v AS (SELECT k, unnest(range(1, CAST(k AS BIGINT) + 2)) AS x FROM (SELECT r_regionkey + 1 AS k FROM region UNION SELECT n_nationkey + 1 FROM nation)),
s AS (SELECT k, count(*) - 1 AS v, avg(power(-0.7, CAST(x AS INT)) + k / 60.0) / (stddev_samp(power(-0.7, CAST(x AS INT)) + k / 60.0) / sqrt(count(*))) AS t FROM v GROUP BY k) SELECT k, v AS df, round(t, 6) AS t, round({p_sql('t', 'v')}, 5) AS p FROM s WHERE v > 3""")
def small_t_values(spark, sf_dir) -> DataFrame:
    """t and p of few values: from 5 to 26 of them."""
    from .functions.stats import t_statistic

    keys = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("k")).union(read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("k"))).distinct()
    v = keys.select("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k") + 1)).alias("x")).select("k", (F.pow(F.lit(-0.7), "x") + F.col("k") / 60.0).alias("y"))
    d = v.groupBy("k").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.stddev_samp("y").alias("sd")).filter("n > 4")
    t = t_statistic(F.col("n"), F.col("m"), F.col("sd"))
    return d.select("k", (F.col("n") - 1).alias("df"), F.round(t, 6).alias("t"), F.round(t_p_value(t, (F.col("n") - 1).cast("double")), 5).alias("p"))



# Plugins, runs and streams ----------------------------------------------------------------------


@query("s18_j10_installs", """WITH o AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT CASE WHEN c_custkey % 7 = 0 THEN 'C ' ELSE 'c-' END || c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'bad id' WHEN c_custkey % 5 = 0 THEN 'bad version' WHEN c_custkey % 3 = 0 THEN 'provides nothing' END AS error,
  CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN NULL ELSE k IS NULL OR k % 2 = 0 END AS enabled,
  CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN NULL WHEN k IS NULL THEN '14' ELSE CAST(k AS VARCHAR) END AS period FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def installs(spark, sf_dir) -> DataFrame:
    """Manifests, one a customer, some of them wrong, and the installations that orders stand for."""
    key = F.col("c_custkey")
    manifest = F.to_json(F.struct(
        F.concat(F.when(key % 7 == 0, "C ").otherwise("c-"), key).alias("id"), F.when(key % 5 == 0, "1.0").otherwise("1.0.0").alias("version"), F.lit("feature").alias("kind"),
        F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c"), key, F.lit(".value")))).alias("provides"), F.create_map(F.lit("period"), F.lit("14")).alias("config"),
    ))
    found = parse_manifests(read(spark, sf_dir, "customer").select(manifest.alias("value")))
    set_ = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"))
    set_ = set_.select(F.concat(F.lit("c-"), "o_custkey").alias("id"), (F.col("k") % 2 == 0).alias("enabled"), F.create_map(F.lit("period"), F.col("k").cast("string")).alias("config"))
    live = installed(found, set_).select("id", "enabled", F.col("config")["period"].alias("period"))
    return found.select("id", "error").join(live, "id", "left")


TRADES = SIM[: SIM.rindex("SELECT instrument, direction, entry_ts, round(any_value(ep)")]


@query("x10_trade_rows", TRADES + """ SELECT instrument, direction, entry_ts, CAST(CAST(entry_ts AS DATE) AS VARCHAR) AS session_date, year(entry_ts) AS year, isodow(entry_ts) AS day_of_week, hour(entry_ts) * 60 + minute(entry_ts) AS minute_of_day,
  'b1' AS batch, 'events' AS source FROM y GROUP BY instrument, direction, entry_ts""")
def trade_rows(spark, sf_dir) -> DataFrame:
    rows = research.trade_rows(simulated(spark, sf_dir), INSTRUMENT, "b1", "events")
    return rows.select("instrument", "direction", "entry_ts", F.col("session_date").cast("string").alias("session_date"), "year", "day_of_week", "minute_of_day", "batch", "source")


@query("run_warmup", f"WITH {H1}, c AS (SELECT *, hour(ts + INTERVAL 1 HOUR) * 60 AS cm, ts + INTERVAL 1 HOUR AS ct, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS k, lead(ts) OVER (PARTITION BY instrument ORDER BY ts) AS entry_ts FROM h) SELECT instrument, entry_ts, unnest(['long', 'short']) AS direction FROM c WHERE cm = 600 AND isodow(ct) <= 5 AND k > 250 AND entry_ts IS NOT NULL")
def run_warmup(spark, sf_dir) -> DataFrame:
    """A run of one rule: its trades begin after 250 bars."""
    own = builtin_plugins(INSTRUMENT, 60)
    for p in own.ordered("entry"):
        own.enable(p.id, p.id == "entry-time-of-day")
    for p in own.ordered("feature"):
        own.enable(p.id, p.id in ("core-candle", "core-volatility"))
    rows = research.run(bars_h1(spark, sf_dir), own, INSTRUMENT, 60, **{"entry-time-of-day": {"minute": 600, "tp": 150, "sl": 100, "hold": 360}})
    return rows.filter("features IS NOT NULL").select("instrument", "entry_ts", "direction")


def _live(spark, sf_dir, name: str, make) -> DataFrame:
    """Bars in a watched folder, worked through as a stream."""
    folder = scratch(spark, f"{name}-in")
    bars_h1(spark, sf_dir).withColumn("timeframe", F.lit("H1")).select(*BAR_SCHEMA.names).write.parquet(folder)
    out = scratch(spark, f"{name}-out")
    stream = make(live_bars.bar_stream(spark, folder))
    live_bars.run_available(stream, out, scratch(spark, f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(out)


#: Bars with a spread that differs from hour to hour.
H1_SPREAD = H1.replace("1.0::DOUBLE AS spread", "CAST(1 + (hour(date_trunc('hour', ts)) * 7) % 5 AS DOUBLE) AS spread")


def _with_spread(b: DataFrame) -> DataFrame:
    return b.withColumn("spread", (1 + (F.hour("ts") * 7) % 5).cast("double"))


def _live_sql(day: str, closed: str) -> str:
    return f"""WITH {H1_SPREAD}, w AS (SELECT instrument, {day}, arg_min(open, ts) AS open, max(high) AS high, arg_max(close, ts) AS close, sum(tick_volume) AS tick_volume,
  arg_max(spread, ts) AS spread, count(*) AS bar_count FROM h GROUP BY ALL) SELECT instrument, ts, open, high, close, tick_volume, spread, bar_count FROM w WHERE {closed}"""


@query("st1_live_resample", _live_sql("make_timestamp((epoch_us(h.ts) // 14400000000) * 14400000000) AS ts", "ts + INTERVAL 4 HOUR <= (SELECT max(ts) FROM h) - INTERVAL 10 MINUTE"))
def live_resample(spark, sf_dir) -> DataFrame:
    """Closed four-hour bars of a stream: those that the watermark has passed."""
    return _live(spark, sf_dir, "resample", lambda b: live_bars.resample_stream(_with_spread(b), "H4")).select("instrument", "ts", "open", "high", "close", "tick_volume", "spread", "bar_count")


NY_DAY = "CAST(timezone('America/New_York', timezone('UTC', h.ts)) AS DATE)"


@query("st1_live_days", _live_sql(f"{NY_DAY} AS d, min(h.ts) AS ts", f"d + INTERVAL 1 DAY <= (SELECT max(timezone('America/New_York', timezone('UTC', h.ts))) FROM h) - INTERVAL 10 MINUTE"))
def live_days(spark, sf_dir) -> DataFrame:
    """Closed days of the market, of a stream."""
    return _live(spark, sf_dir, "days", lambda b: live_bars.resample_stream(_with_spread(b), "D1", tz="America/New_York")).select("instrument", "ts", "open", "high", "close", "tick_volume", "spread", "bar_count")


@query("st2_live_session", ORACLE_BARS["g13_running_session"])
def live_session(spark, sf_dir) -> DataFrame:
    return _live(spark, sf_dir, "session", lambda b: live_bars.session_stream(b, "UTC"))


@query("st3_live_mean", ORACLE_BARS["w2_sma"])
def live_mean(spark, sf_dir) -> DataFrame:
    return _live(spark, sf_dir, "mean", lambda b: live_bars.sliding_stream(b, 20)).select("instrument", "ts", F.round("mean", 6).alias("sma20"))


@query("st4_live_indicators", f"SELECT e.instrument, e.ts, ema20, atr14 FROM ({ORACLE_BARS['w1_ema']}) e JOIN ({ORACLE_BARS['w4_atr']}) a ON a.instrument = e.instrument AND a.ts = e.ts")
def live_indicators(spark, sf_dir) -> DataFrame:
    """Averages after every bar of a stream."""
    d = _live(spark, sf_dir, "indicators", live_bars.indicator_stream)
    return d.select("instrument", "ts", F.round("ema", 5).alias("ema20"), F.round("atr", 5).alias("atr14"))


_E1 = SIM[: SIM.index("sg AS (")] + f"sg AS ({ORACLE_BARS['e1_time_of_day']})" + SIM[SIM.index(",\np AS (") : SIM.rindex("SELECT instrument, direction, entry_ts, round(any_value(ep)")]


@query("st4_live_trades", f"""{_E1}, z AS (SELECT instrument, direction, entry_ts, max(bts) AS exit_ts, coalesce(arg_max(coalesce(reason, '-'), bts), '-') AS exit_reason, any_value(ep) AS ep, any_value(sn) AS sn, arg_max(close, bts) AS last FROM y GROUP BY ALL)
SELECT instrument, direction, entry_ts, exit_ts, exit_reason, round(CASE exit_reason WHEN 'stop_loss' THEN -150 WHEN 'take_profit' THEN 150 ELSE (last - ep) * sn END, 6) AS pnl_points FROM z WHERE exit_reason <> '-'""")
def live_trades(spark, sf_dir) -> DataFrame:
    """Trades of a rule as they end, of a stream of bars; equal to the batch's."""
    d = _live(spark, sf_dir, "trades", lambda b: live_bars.trade_stream(b, 600, "UTC", 60, tp=150, sl=150, hold=360))
    return d.filter("exit_reason <> 'session_end'").select("instrument", "direction", "entry_ts", "exit_ts", "exit_reason", (F.round("pnl_points", 6) + 0.0).alias("pnl_points"))


@query("s15_feature_matrix", f"""WITH {OBS_SQL}, m AS (SELECT id, pnl_cents, CASE WHEN id % 11 = 0 THEN NULL ELSE f_balance END AS balance, CASE WHEN id % 7 < 2 THEN NULL ELSE f_lines END AS lines, f_discount AS discount FROM obs)
SELECT variable, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS nulls, round(sum(v), 2) AS total, CAST(sum(CASE WHEN id % 5 = 0 THEN 0 ELSE pnl_cents END) AS BIGINT) AS net
FROM (SELECT id, pnl_cents, unnest(['obs_balance', 'obs_discount', 'obs_lines', 'obs_note']) AS variable, unnest([balance, discount, lines, NULL]) AS v FROM m) GROUP BY variable""")
def matrix(spark, sf_dir) -> DataFrame:
    """Features stored as JSON with empty texts, infinities and words among the numbers, loaded by the keys that occur."""
    from .sources.matrix import feature_matrix, null_counts

    lines = F.when(F.col("id") % 7 == 0, "").when(F.col("id") % 7 == 1, "Infinity").otherwise(F.col("f_lines").cast("string"))
    stored = observations(spark, sf_dir).select("id", F.when(F.col("id") % 5 != 0, F.col("pnl_cents")).alias("pnl_cents"), F.to_json(F.struct(
        F.when(F.col("id") % 11 != 0, F.col("f_balance")).alias("obs.balance"), lines.alias("obs.lines"), F.col("f_discount").alias("obs.discount"), F.lit("a word").alias("obs.note"),
    )).alias("features"))
    m = feature_matrix(stored, "features", ["id", "pnl_cents"], "pnl_cents")
    names = [c for c in m.columns if c.startswith("obs_")]
    sums = m.select("pnl_cents", F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).alias("v")) for c in names))).alias("x"))
    sums = sums.groupBy("x.variable").agg(F.round(F.sum("x.v"), 2).alias("total"), F.sum("pnl_cents").alias("net"))
    return null_counts(m, names).join(sums, "variable")


@query("k3_k5_stored_replacement", f"""WITH {OBS_SQL}, a AS (SELECT id, pnl_cents, f_year FROM obs WHERE id % 3 <> 0), n AS (SELECT id, pnl_cents + 100 AS pnl_cents, CASE WHEN id % 10 = 0 THEN 1990.0 ELSE f_year END AS f_year FROM obs WHERE f_year = 1996 AND id % 2 = 0),
u AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n)
SELECT CAST(f_year AS INT) AS y, count(*) AS n, CAST(sum(pnl_cents) AS BIGINT) AS net, f_year NOT IN (1996, 1990, 1997) AS kept FROM u WHERE f_year <> 1997 OR id % 4 <> 1 GROUP BY f_year""")
def replacement(spark, sf_dir) -> DataFrame:
    """A table stored by years: rows put in by key (some move to another year), twice, and rows deleted. Other years keep their files."""
    d = observations(spark, sf_dir).select("id", "pnl_cents", F.col("f_year").cast("int").alias("y"))
    path = scratch(spark, "trades")
    d.filter("id % 3 <> 0").write.partitionBy("y").parquet(path)
    files = lambda: spark.read.schema(d.schema).parquet(path).select("y", F.col("_metadata.file_name").alias("f")).groupBy("y").agg(F.sort_array(F.collect_set("f")).alias("f"))
    before = storage.settle(files().withColumnRenamed("f", "before"))
    new = d.filter("y = 1996 AND id % 2 = 0").withColumn("pnl_cents", F.col("pnl_cents") + 100).withColumn("y", F.when(F.col("id") % 10 == 0, 1990).otherwise(F.col("y")))
    for _ in range(2):
        storage.replace_stored(path, new, ["id"], ["pnl_cents"], ["y"])
    storage.delete_stored(path, d, (F.col("y") == 1997) & (F.col("id") % 4 == 1), ["y"])
    same = files().join(before, "y", "left").select("y", F.coalesce(F.col("f") == F.col("before"), F.lit(False)).alias("kept"))
    return spark.read.schema(d.schema).parquet(path).groupBy("y").agg(F.count("*").alias("n"), F.sum("pnl_cents").alias("net")).join(same, "y")


@query("sc10_formatted", f"""WITH {OBS_SQL}, g AS (SELECT f_year, count(*) AS n, count(*) FILTER (WHERE pnl_cents > 0) / nullif(count(*) FILTER (WHERE pnl_cents <> 0), 0) AS wr,
  CASE WHEN count(*) > 1 THEN stddev_samp(CAST(pnl_cents AS DOUBLE)) END AS sd FROM obs WHERE rule_id = 'P' GROUP BY 1)
SELECT f_year, printf('%.2f', sd / 100) AS sd, printf('%.1f%%', wr * 100) AS win_rate, format('{{:,}}', n) AS n FROM g WHERE n > 1""")
def formatted(spark, sf_dir) -> DataFrame:
    d = observations(spark, sf_dir).filter("rule_id = 'P'").groupBy("f_year").agg(
        F.count("*").alias("n"), F.try_divide(F.count_if(F.col("pnl_cents") > 0).cast("double"), F.count_if(F.col("pnl_cents") != 0).cast("double")).alias("wr"), F.stddev_samp(F.col("pnl_cents").cast("double")).alias("s"))
    return d.filter("n > 1").select("f_year", num(F.col("s") / 100).alias("sd"), pct(F.col("wr")).alias("win_rate"), integer(F.col("n")).alias("n"))


@query("st6_complete_bars", f"WITH {H1} SELECT instrument, ts, close FROM h WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM h) - INTERVAL 1 DAY")
def complete_bars(spark, sf_dir) -> DataFrame:
    """The bars that may be seen one day before the last bar opens; the guard lets them all through."""
    b = bars_h1(spark, sf_dir)
    now = F.lit(b.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("now")).first()["now"]).cast("timestamp_ntz")
    return bar_ops.require_complete(bar_ops.closed_by(b, now, 60), now, 60).select("instrument", "ts", "close")
