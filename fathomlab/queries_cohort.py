"""Registered queries over observations, with their DuckDB oracles. Keys start with the identifiers of
the operator inventory that they show."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .functions.stats import benjamini_hochberg, bonferroni, wilson
from .operators import cohorts, discovery, hypotheses, marginal, metrics
from .operators.intervals import inside
from .operators.ordered import equity
from .plans.language import parse
from .plans.predicates import And, Between, Compare, In, IsNull, Not, Or, Predicate, as_filter, as_mask
from .sources.views import OBS, TRAIN, VALIDATION, in_split, observations, read

OBS_SQL = """obs AS (
  SELECT o_orderkey AS id, o_orderdate AS entry_ts,
    CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) - 25000000 END AS pnl_cents,
    o_orderstatus AS rule_id, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END AS direction,
    CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS f_priority,
    CAST(list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment) - 1 AS DOUBLE) AS f_segment,
    CAST(isodow(o_orderdate) AS DOUBLE) AS f_dow, c_acctbal AS f_balance, f_lines, f_quantity, f_discount,
    CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(last_ship AS DATE)) AS DOUBLE) AS f_shipped_days, CAST(year(o_orderdate) AS DOUBLE) AS f_year
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (
    SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS f_lines, sum(l_quantity) AS f_quantity,
      round(sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) / 100, 4) AS f_discount, max(l_shipdate) AS last_ship
    FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
), train AS (SELECT * FROM obs WHERE entry_ts >= TIMESTAMP '1995-01-01' AND entry_ts < TIMESTAMP '2000-01-01'),
validation AS (SELECT * FROM obs WHERE entry_ts >= TIMESTAMP '2000-01-10' AND entry_ts < TIMESTAMP '2002-01-01')"""

#: The flagship condition.
TEXT = "obs.lines > 4 and not obs.segment == 2"
Q, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def predicate_query(name: str, p: Predicate | str, sql_condition: str) -> None:
    """Count and sum of the rows that a predicate selects, as a filter and as a mask."""

    def run(spark, sf_dir) -> DataFrame:
        rule = parse(p) if isinstance(p, str) else p
        obs = observations(spark, sf_dir)
        kept = obs.filter(as_filter(rule, OBS.column)).agg(F.count("*").alias("n_filter"), F.coalesce(F.sum("pnl_cents"), F.lit(0)).alias("sum_filter"))
        mask = obs.agg(F.count_if(as_mask(rule, OBS.column)).alias("n_mask"), F.count_if(~as_mask(rule, OBS.column)).alias("n_other"))
        return kept.join(F.broadcast(mask))

    query(name, f"""WITH {OBS_SQL}, m AS (SELECT coalesce({sql_condition}, false) AS m, pnl_cents FROM obs)
        SELECT count(*) FILTER (WHERE m) AS n_filter, CAST(coalesce(sum(pnl_cents) FILTER (WHERE m), 0) AS BIGINT) AS sum_filter,
        count(*) FILTER (WHERE m) AS n_mask, count(*) FILTER (WHERE NOT m) AS n_other FROM m""")(run)


predicate_query("p1_always", "", "true")
for _op, _sym in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<="), ("eq", "="), ("neq", "<>")):
    predicate_query(f"p2_compare_{_op}", Compare("obs.lines", _op, 4.0), f"f_lines {_sym} 4")
predicate_query("p3_between_half_open", Between("obs.lines", 2.0, 5.0), "f_lines >= 2 AND f_lines < 5")
predicate_query("p3_between_inclusive", "obs.lines between 2 and 5", "f_lines >= 2 AND f_lines <= 5")
predicate_query("p3_between_unbounded", Between("obs.lines", float("-inf"), 3.0), "f_lines < 3")
predicate_query("p4_in", "obs.segment in (0, 3)", "f_segment IN (0, 3)")
predicate_query("p4_in_empty", In("obs.segment", ()), "false")
predicate_query("p5_is_null", "obs.lines is null", "f_lines IS NULL")
predicate_query("p6_and", And((Compare("obs.lines", "gt", 2.0), Compare("obs.balance", "lt", 0.0))), "f_lines > 2 AND f_balance < 0")
predicate_query("p7_or", Or((Compare("obs.lines", "gt", 6.0), IsNull("obs.discount"))), "coalesce(f_lines > 6, false) OR f_discount IS NULL")
predicate_query("p8_not_selects_nulls", Not(Compare("obs.lines", "eq", 4.0)), "NOT coalesce(f_lines = 4, false)")
predicate_query("p15_language", "not (obs.lines >= 3 and (obs.segment = 1 or obs.priority in (1, 5))) and obs.dow between 1 and 5",
                "NOT coalesce(f_lines >= 3 AND (f_segment = 1 OR f_priority IN (1, 5)), false) AND f_dow BETWEEN 1 AND 5")


@query("p18_trade_filter", f"WITH {OBS_SQL} SELECT count(*) AS n, CAST(sum(pnl_cents) AS BIGINT) AS total FROM obs WHERE rule_id = 'O' AND direction = 1 AND entry_ts >= TIMESTAMP '1996-01-01' AND entry_ts < TIMESTAMP '1999-07-01'")
def trade_filter(spark, sf_dir) -> DataFrame:
    obs = observations(spark, sf_dir)
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    return obs.filter((F.col("rule_id") == "O") & (F.col("direction") == 1) & (F.col("entry_ts") >= ts("1996-01-01")) & (F.col("entry_ts") < ts("1999-07-01"))).agg(F.count("*").alias("n"), F.sum("pnl_cents").alias("total"))


@query("p19_splits", f"WITH {OBS_SQL} SELECT 'train' AS split, count(*) AS n, min(id) AS first_id FROM train UNION ALL SELECT 'validation', count(*), min(id) FROM validation")
def splits(spark, sf_dir) -> DataFrame:
    obs = observations(spark, sf_dir)
    one = lambda s: in_split(obs, s).agg(F.lit(s.name).alias("split"), F.count("*").alias("n"), F.min("id").alias("first_id"))
    return one(TRAIN).unionByName(one(VALIDATION))


METRIC_ROUNDED = metrics.METRICS
_INTEGER = {"n", "wins", "losses", "break_even", "max_drawdown_length", "max_wins", "max_losses"}


def shown(df: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics rounded for comparison; an infinite ratio is null."""
    finite = lambda c: F.when(F.abs(F.col(c)) < 1e300, F.round(F.col(c), 6) + 0.0)
    return df.select(*keys, *(F.col(c).cast("long").alias(c) if c in _INTEGER else finite(c).alias(c) for c in METRIC_ROUNDED))


def p_sql(t: str, v: str) -> str:
    """P(T > t) of Student's distribution with ``v`` degrees of freedom: its density summed from 0 to t by Simpson's rule; 1 where
    there is no t or no degree."""
    terms = f"list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * power(1 + power(abs({t}) * i / 2000, 2) / ({v}), -(({v}) + 1) / 2.0))"
    inner = f"exp(lgamma((({v}) + 1) / 2.0) - lgamma(({v}) / 2.0)) / sqrt(({v}) * pi()) * abs({t}) / 6000 * list_sum({terms})"
    return f"CASE WHEN {t} IS NULL OR {v} <= 0 THEN 1 WHEN {t} >= 0 THEN greatest(0, 0.5 - {inner}) ELSE 0.5 + {inner} END"


def metrics_sql(source: str, key: str) -> str:
    """All metrics of ``source`` (with columns g, entry_ts, id, pnl_cents) by g, in DuckDB."""
    return f"""
s AS (SELECT * FROM ({source})),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY entry_ts, id) - 1 AS i, sum(pnl_cents) OVER (PARTITION BY g ORDER BY entry_ts, id ROWS UNBOUNDED PRECEDING) AS e FROM s),
p AS (SELECT *, greatest(0, max(e) OVER (PARTITION BY g ORDER BY i ROWS UNBOUNDED PRECEDING)) AS pk FROM o),
deep AS (SELECT g, arg_max(pk, (pk - e) * 10000000000::HUGEINT - i) AS dpk, max(pk - e) AS dd, min(i) FILTER (WHERE pk - e = mx) AS di FROM (SELECT *, max(pk - e) OVER (PARTITION BY g) AS mx FROM p) GROUP BY g),
peak AS (SELECT p.g, min(i) AS pi FROM p JOIN deep d ON d.g = p.g WHERE e = dpk AND dpk > 0 GROUP BY p.g),
r AS (SELECT g, sign(pnl_cents) AS sg, count(*) AS len FROM (SELECT g, pnl_cents, i - row_number() OVER (PARTITION BY g, sign(pnl_cents) ORDER BY i) AS grp FROM o) GROUP BY g, sign(pnl_cents), grp),
st AS (SELECT g, coalesce(max(len) FILTER (WHERE sg = 1), 0) AS mw, coalesce(max(len) FILTER (WHERE sg = -1), 0) AS ml FROM r GROUP BY g),
c AS (SELECT g, count(*) AS n, avg(i) AS mi, avg(e) AS me FROM o GROUP BY g),
tr AS (SELECT o.g, any_value(n) AS n, sum((i - mi) * (e - me)) AS ab, sum((i - mi) * (i - mi)) AS aa, sum((e - me) * (e - me)) AS bb FROM o JOIN c ON c.g = o.g GROUP BY o.g),
a AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE pnl_cents > 0) AS w, count(*) FILTER (WHERE pnl_cents < 0) AS l, count(*) FILTER (WHERE pnl_cents = 0) AS b,
  CAST(coalesce(sum(pnl_cents) FILTER (WHERE pnl_cents > 0), 0) AS DOUBLE) AS gp, CAST(coalesce(-sum(pnl_cents) FILTER (WHERE pnl_cents < 0), 0) AS DOUBLE) AS gl,
  CASE WHEN count(*) > 1 THEN stddev_samp(CAST(pnl_cents AS DOUBLE)) END AS sd, sum(CAST(pnl_cents AS DOUBLE) * pnl_cents) FILTER (WHERE pnl_cents < 0) AS dn,
  quantile_cont(CAST(pnl_cents AS DOUBLE), [0.05, 0.5, 0.95]) AS q FROM s GROUP BY g)
SELECT a.g AS {key}, a.n, w AS wins, l AS losses, b AS break_even, gp AS gross_profit, gl AS gross_loss, gp - gl AS net_profit,
 round(w / nullif(w + l, 0), 6) AS win_rate,
 round(CASE WHEN w + l = 0 THEN 0 ELSE greatest(0, (w / (w + l) + z2 / (2 * (w + l)) - z * sqrt(w / (w + l) * (1 - w / (w + l)) / (w + l) + z2 / (4.0 * (w + l) * (w + l)))) / (1 + z2 / (w + l))) END, 6) AS ci_low,
 round(CASE WHEN w + l = 0 THEN 1 ELSE least(1, (w / (w + l) + z2 / (2 * (w + l)) + z * sqrt(w / (w + l) * (1 - w / (w + l)) / (w + l) + z2 / (4.0 * (w + l) * (w + l)))) / (1 + z2 / (w + l))) END, 6) AS ci_high,
 round(gp / nullif(gl, 0), 6) AS profit_factor, round((gp - gl) / a.n, 6) AS expectancy, round(gp / nullif(w, 0), 6) AS avg_win, round(gl / nullif(l, 0), 6) AS avg_loss,
 round((gp / nullif(w, 0)) / (gl / nullif(l, 0)), 6) AS payoff, round(sd, 6) AS std_dev, round(CASE WHEN sd > 0 THEN (gp - gl) / a.n / sd END, 6) AS sharpe,
 round((gp - gl) / a.n / nullif(sqrt(coalesce(dn, 0) / a.n), 0), 6) AS sortino, CAST(dd AS DOUBLE) AS max_drawdown,
 round(CASE WHEN dpk > 0 THEN dd / dpk ELSE 0 END, 6) AS max_drawdown_pct, CAST(CASE WHEN dd > 0 THEN di - coalesce(pi, 0) ELSE 0 END AS BIGINT) AS max_drawdown_length,
 mw AS max_wins, ml AS max_losses, round(CASE WHEN a.n >= 3 AND aa > 0 AND bb > 0 THEN ab * ab / (aa * bb) END, 6) AS equity_r2,
 round(q[2], 6) AS median, round(q[1], 6) AS p05, round(q[3], 6) AS p95,
 round(tt, 6) AS t_stat, round({p_sql("tt", "a.n - 1")}, 6) AS p_value
FROM (SELECT *, CASE WHEN n >= 2 THEN CASE WHEN sd > 0 THEN (gp - gl) / n / (sd / sqrt(n)) WHEN gp > gl THEN NULL ELSE 0 END END AS tt FROM a) a JOIN deep ON deep.g = a.g LEFT JOIN peak ON peak.g = a.g JOIN st ON st.g = a.g JOIN tr ON tr.g = a.g, (SELECT 1.959963984540054 AS z, 1.959963984540054 * 1.959963984540054 AS z2)"""


COND = "coalesce(f_lines > 4, false) AND NOT coalesce(f_segment = 2, false)"


@query("g1_cohort_metrics", f"WITH {OBS_SQL}, {metrics_sql(f'SELECT 1 AS g, entry_ts, id, pnl_cents FROM train WHERE {COND}', 'one')}".replace("a.g AS one, ", "round((SELECT count(*) FROM s) / (SELECT count(*) FROM train), 6) AS coverage, "))
def cohort(spark, sf_dir) -> DataFrame:
    """Text to predicate to filter to all metrics, on the training split."""
    d = cohorts.cohort_metrics(in_split(observations(spark, sf_dir), TRAIN), parse(TEXT), OBS)
    return shown(d.withColumn("coverage", F.round("coverage", 6)), ["coverage"])


@query("g2_both_sides", f"WITH {OBS_SQL}, {metrics_sql(f'SELECT {COND} AS g, entry_ts, id, pnl_cents FROM train', 'side')}")
def both_sides(spark, sf_dir) -> DataFrame:
    return shown(cohorts.both_sides(in_split(observations(spark, sf_dir), TRAIN), parse(TEXT), OBS), ["side"])


@query("m_metrics_by_rule", f"WITH {OBS_SQL}, {metrics_sql('SELECT rule_id AS g, entry_ts, id, pnl_cents FROM obs', 'rule_id')}")
def metrics_by_rule(spark, sf_dir) -> DataFrame:
    return shown(metrics.summarize(observations(spark, sf_dir), ["rule_id"]), ["rule_id"])


@query("m17_empty_cohort", "SELECT 0::BIGINT AS n, 0::BIGINT AS wins, NULL::DOUBLE AS win_rate, NULL::DOUBLE AS ci_low, 0.0::DOUBLE AS max_drawdown, 1.0::DOUBLE AS p_value FROM (SELECT count(*) FROM orders)")
def empty_cohort(spark, sf_dir) -> DataFrame:
    d = metrics.summarize(observations(spark, sf_dir).filter("f_lines > 1000"))
    return d.select("n", "wins", "win_rate", "ci_low", "max_drawdown", "p_value")


HALF = "SELECT CASE WHEN row_number() OVER (ORDER BY entry_ts, id) <= count(*) OVER () // 2 THEN 1 ELSE 2 END AS g, entry_ts, id, pnl_cents FROM train"


@query("g3_halves", f"WITH {OBS_SQL}, {metrics_sql(HALF, 'half')}")
def halves(spark, sf_dir) -> DataFrame:
    return shown(metrics.summarize(cohorts.halves(in_split(observations(spark, sf_dir), TRAIN)), ["half"]), ["half"])


@query("g3_stability", f"""WITH {OBS_SQL}, h AS ({HALF}), m AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE pnl_cents > 0) / count(*) FILTER (WHERE pnl_cents <> 0) AS wr, sum(pnl_cents) / count(*) AS ex FROM h GROUP BY g)
SELECT a.n AS n_first, b.n AS n_second, round(b.wr - a.wr, 6) AS win_rate_delta, round(b.ex / a.ex, 6) AS expectancy_ratio FROM m a, m b WHERE a.g = 1 AND b.g = 2""")
def stability(spark, sf_dir) -> DataFrame:
    d = cohorts.stability(in_split(observations(spark, sf_dir), TRAIN))
    return d.select("n_first", "n_second", F.round("win_rate_delta", 6).alias("win_rate_delta"), F.round("expectancy_ratio", 6).alias("expectancy_ratio"))


@query("g4_mask_algebra", f"WITH {OBS_SQL}, m AS (SELECT coalesce(f_lines > 3, false) AS a, coalesce(f_balance < 0, false) AS b FROM obs) SELECT count(*) FILTER (WHERE a AND b) AS n_and, count(*) FILTER (WHERE a OR b) AS n_or, count(*) FILTER (WHERE NOT a) AS n_not FROM m")
def mask_algebra(spark, sf_dir) -> DataFrame:
    a, b = (as_mask(parse(t), OBS.column) for t in ("obs.lines > 3", "obs.balance < 0"))
    return observations(spark, sf_dir).agg(F.count_if(a & b).alias("n_and"), F.count_if(a | b).alias("n_or"), F.count_if(~a).alias("n_not"))


@query("g15_g18_counts_and_nulls", f"WITH {OBS_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE f_lines IS NULL) AS null_lines, count(*) FILTER (WHERE f_discount IS NULL) AS null_discount, count(*) FILTER (WHERE f_balance IS NULL) AS null_balance FROM obs")
def null_counts(spark, sf_dir) -> DataFrame:
    return observations(spark, sf_dir).agg(F.count("*").alias("n"), *(F.count_if(F.col(f"f_{c}").isNull()).alias(f"null_{c}") for c in ("lines", "discount", "balance")))


@query("w11_equity_curve", f"WITH {OBS_SQL} SELECT id, row_number() OVER (ORDER BY entry_ts, id) - 1 AS i, CAST(sum(pnl_cents) OVER (ORDER BY entry_ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS equity FROM train")
def equity_curve(spark, sf_dir) -> DataFrame:
    return cohorts.equity_curve(in_split(observations(spark, sf_dir), TRAIN)).select("id", F.col("i").cast("long").alias("i"), "equity")


@query("w12_downsample", f"""WITH {OBS_SQL}, e AS (SELECT row_number() OVER (ORDER BY entry_ts, id) - 1 AS i, CAST(sum(pnl_cents) OVER (ORDER BY entry_ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS equity FROM train),
n AS (SELECT count(*) AS n FROM e), k AS (SELECT DISTINCT CAST(floor(x * n / 300.0) AS BIGINT) AS i FROM n, range(0, 300) t(x)),
kept AS (SELECT e.i, equity FROM e JOIN k ON k.i = e.i), z AS (SELECT i, equity FROM e ORDER BY i DESC LIMIT 1)
SELECT i, equity FROM kept UNION ALL SELECT z.i, z.equity FROM z, (SELECT * FROM kept ORDER BY i DESC LIMIT 1) t WHERE t.i < z.i AND t.equity <> z.equity""")
def downsample(spark, sf_dir) -> DataFrame:
    curve = equity(in_split(observations(spark, sf_dir), TRAIN).withColumn("__all", F.lit(1)), ["__all"]).select(F.col("i").cast("long").alias("i"), "equity")
    return cohorts.downsample(curve, "i", "equity")


@query("t5_page", f"WITH {OBS_SQL} SELECT id, pnl_cents FROM obs ORDER BY entry_ts, id LIMIT 100 OFFSET 250")
def page(spark, sf_dir) -> DataFrame:
    return observations(spark, sf_dir).select("id", "pnl_cents", "entry_ts").orderBy("entry_ts", "id").offset(250).limit(100).select("id", "pnl_cents")


@query("g17_visible_profit", f"WITH {OBS_SQL} SELECT CAST(sum(pnl_cents) FILTER (WHERE entry_ts <= TIMESTAMP '1998-06-30') AS BIGINT) AS visible, CAST(sum(pnl_cents) AS BIGINT) AS total FROM obs")
def visible_profit(spark, sf_dir) -> DataFrame:
    cursor = F.lit("1998-06-30").cast("timestamp_ntz")
    return observations(spark, sf_dir).agg(F.sum(F.when(F.col("entry_ts") <= cursor, F.col("pnl_cents"))).alias("visible"), F.sum("pnl_cents").alias("total"))


# Marginals --------------------------------------------------------------------------------------

BUCKET_KEYS = ["obs.priority", "obs.segment", "obs.balance", "obs.lines", "obs.quantity", "obs.discount"]
BUCKET_SQL = """e AS (SELECT quantile_cont(CAST(f_balance AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS qb, quantile_cont(f_discount, [0.25, 0.5, 0.75]) AS qd FROM train),
x AS (
 SELECT 'obs.priority' AS variable, f_priority AS bucket, pnl_cents, entry_ts, id FROM train
 UNION ALL SELECT 'obs.segment', f_segment, pnl_cents, entry_ts, id FROM train
 UNION ALL SELECT 'obs.balance', CASE WHEN f_balance IS NOT NULL THEN CAST(len(list_filter(list_distinct(qb), lambda y: y <= f_balance)) AS DOUBLE) END, pnl_cents, entry_ts, id FROM train, e
 UNION ALL SELECT 'obs.lines', CASE WHEN f_lines IS NOT NULL THEN CAST(len(list_filter([2, 4, 6], lambda y: y <= f_lines)) AS DOUBLE) END, pnl_cents, entry_ts, id FROM train
 UNION ALL SELECT 'obs.quantity', CASE WHEN f_quantity IS NOT NULL THEN floor(f_quantity / 50) - (SELECT floor(min(f_quantity) / 50) FROM train) END, pnl_cents, entry_ts, id FROM train
 UNION ALL SELECT 'obs.discount', CASE WHEN f_discount IS NOT NULL THEN CAST(len(list_filter(list_distinct(qd), lambda y: y <= f_discount)) AS DOUBLE) END, pnl_cents, entry_ts, id FROM train, e
), b AS (SELECT variable, bucket, count(*) AS n, CAST(sum(pnl_cents) AS BIGINT) AS net, sum(pnl_cents) / count(*) AS ex,
  CASE WHEN count(*) > 1 THEN stddev_samp(CAST(pnl_cents AS DOUBLE)) END AS sd, count(*) FILTER (WHERE pnl_cents > 0) AS w, count(*) FILTER (WHERE pnl_cents < 0) AS l FROM x GROUP BY variable, bucket),
base AS (SELECT sum(pnl_cents) / count(*) AS m FROM train)"""


@query("g5_buckets", f"WITH {OBS_SQL}, {BUCKET_SQL} SELECT variable, bucket, n, CAST(net AS DOUBLE) AS net_profit, round(ex, 4) AS expectancy, round(w / nullif(w + l, 0), 6) AS win_rate, round(ex - m, 4) AS lift, round(CASE WHEN sd > 0 THEN ex / (sd / sqrt(n)) WHEN n > 1 AND ex > 0 THEN NULL WHEN n > 1 THEN 0 END, 6) AS t_stat FROM b, base")
def buckets(spark, sf_dir) -> DataFrame:
    d = marginal.buckets(in_split(observations(spark, sf_dir), TRAIN), BUCKET_KEYS, OBS)
    t = F.when(F.abs("t_stat") < 1e300, F.round("t_stat", 6))
    return d.select("variable", "bucket", "n", "net_profit", F.round("expectancy", 4).alias("expectancy"), F.round("win_rate", 6).alias("win_rate"), F.round("lift", 4).alias("lift"), t.alias("t_stat"))


@query("g6_edges", f"WITH {OBS_SQL}, e AS (SELECT quantile_cont(CAST(f_balance AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS qb FROM train) SELECT k AS place, round(qb[k], 6) AS edge FROM e, range(1, 5) t(k)")
def edges(spark, sf_dir) -> DataFrame:
    found = marginal.edges_of(in_split(observations(spark, sf_dir), TRAIN), [OBS["obs.balance"]], OBS)["obs.balance"]
    return spark.createDataFrame([(k, round(e, 6)) for k, e in enumerate(found, 1)], "place long, edge double")


@query("g8_distinct_values", f"WITH {OBS_SQL} SELECT f_segment AS value, count(*) AS n FROM obs WHERE f_segment IS NOT NULL GROUP BY 1")
def distinct_values(spark, sf_dir) -> DataFrame:
    return observations(spark, sf_dir).filter("f_segment IS NOT NULL").groupBy(F.col("f_segment").alias("value")).agg(F.count("*").alias("n"))


@query("g9_correlation", f"WITH {OBS_SQL} SELECT 'obs.balance' AS variable, count(f_balance) AS n, round(corr(f_balance, CAST(pnl_cents AS DOUBLE)), 5) AS correlation FROM train UNION ALL SELECT 'obs.lines', count(f_lines), round(corr(f_lines, CAST(pnl_cents AS DOUBLE)), 5) FROM train UNION ALL SELECT 'obs.discount', count(f_discount), round(corr(f_discount, CAST(pnl_cents AS DOUBLE)), 5) FROM train")
def correlation(spark, sf_dir) -> DataFrame:
    d = marginal.correlations(in_split(observations(spark, sf_dir), TRAIN), ["obs.balance", "obs.lines", "obs.discount"], OBS)
    return d.withColumn("correlation", F.round("correlation", 5))


@query("g10_rank_variables", f"""WITH {OBS_SQL}, {BUCKET_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY ex DESC, bucket) AS r FROM b WHERE n >= 30 AND bucket IS NOT NULL)
SELECT variable, bucket, n, round(ex - m, 4) AS lift, round(ex / (sd / sqrt(n)), 6) AS t_stat FROM k, base WHERE r = 1""")
def ranked(spark, sf_dir) -> DataFrame:
    d = marginal.rank_variables(in_split(observations(spark, sf_dir), TRAIN), BUCKET_KEYS, OBS)
    return d.select("variable", "bucket", "n", F.round("lift", 4).alias("lift"), F.round("t_stat", 6).alias("t_stat"))


P_SQL = f"WITH {OBS_SQL}, p AS (SELECT id, round((id * 7919 % 10007 + 1) / 10008.0, 6) AS p FROM train)"


@query("w15_benjamini_hochberg", f"{P_SQL}, r AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS rk, count(*) OVER () AS n FROM p) SELECT id, round(least(1.0, min(p * n / rk) OVER (ORDER BY rk DESC)), 6) AS q FROM r")
def bh(spark, sf_dir) -> DataFrame:
    p = in_split(observations(spark, sf_dir), TRAIN).select("id", F.round((F.col("id") * 7919 % 10007 + 1) / F.lit(10008.0), 6).alias("p"))
    return benjamini_hochberg(p, "p").select("id", F.round("q", 6).alias("q"))


@query("i11_bonferroni", f"{P_SQL} SELECT id, round(least(1.0, p * 25), 6) AS q FROM p")
def bonf(spark, sf_dir) -> DataFrame:
    p = F.round((F.col("id") * 7919 % 10007 + 1) / F.lit(10008.0), 6)
    return in_split(observations(spark, sf_dir), TRAIN).select("id", F.round(bonferroni(p, 25), 6).alias("q"))


@query("i5_wilson", f"""WITH {OBS_SQL}, g AS (SELECT f_priority, count(*) FILTER (WHERE pnl_cents > 0) AS w, count(*) FILTER (WHERE pnl_cents <> 0) AS n FROM obs GROUP BY 1), z AS (SELECT 1.959963984540054 AS z)
SELECT f_priority, round((w / n + z * z / (2 * n) - z * sqrt(w / n * (1 - w / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS lower, round((w / n + z * z / (2 * n) + z * sqrt(w / n * (1 - w / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS upper FROM g, z""")
def wilson_query(spark, sf_dir) -> DataFrame:
    d = observations(spark, sf_dir).groupBy("f_priority").agg(F.count_if(F.col("pnl_cents") > 0).alias("w"), F.count_if(F.col("pnl_cents") != 0).alias("n"))
    low, high = wilson(F.col("w"), F.col("n"))
    return d.select("f_priority", F.round(low, 6).alias("lower"), F.round(high, 6).alias("upper"))


@query("i1_descriptive", f"WITH {OBS_SQL} SELECT rule_id, round(avg(f_balance), 4) AS mean, round(var_samp(f_balance), 2) AS variance, round(quantile_cont(CAST(f_balance AS DOUBLE), 0.5), 4) AS median, round(regr_slope(f_quantity, f_lines), 6) AS slope FROM obs GROUP BY rule_id")
def descriptive(spark, sf_dir) -> DataFrame:
    return observations(spark, sf_dir).groupBy("rule_id").agg(
        F.round(F.avg("f_balance"), 4).alias("mean"), F.round(F.var_samp("f_balance"), 2).alias("variance"), F.round(F.percentile("f_balance", 0.5), 4).alias("median"), F.round(F.regr_slope("f_quantity", "f_lines"), 6).alias("slope")
    )


# Discovery --------------------------------------------------------------------------------------

LEVEL1 = f"WITH {OBS_SQL}, {BUCKET_SQL}, c AS (SELECT * FROM b WHERE bucket IS NOT NULL AND n >= 100)"


@query("d1_candidates", f"{LEVEL1} SELECT variable, bucket, n, net FROM c")
def candidates(spark, sf_dir) -> DataFrame:
    found = discovery.candidates(in_split(observations(spark, sf_dir), TRAIN), BUCKET_KEYS, OBS).filter("n >= 100")
    return found.select("variable", "bucket", "n", F.col("net").cast("long").alias("net"))


@query("d2_pairs", f"""{LEVEL1}, m AS (SELECT x.id, x.variable, x.bucket, x.pnl_cents FROM x JOIN c ON c.variable = x.variable AND c.bucket = x.bucket)
SELECT a.variable AS variable_a, a.bucket AS bucket_a, b2.variable AS variable_b, b2.bucket AS bucket_b, count(*) AS n, CAST(sum(a.pnl_cents) AS BIGINT) AS net
FROM m a JOIN m b2 ON a.id = b2.id AND a.variable < b2.variable GROUP BY ALL HAVING count(*) >= 100""")
def pairs(spark, sf_dir) -> DataFrame:
    found = discovery.discover(in_split(observations(spark, sf_dir), TRAIN), BUCKET_KEYS, OBS, max_conditions=2, min_trades=100)
    two = found.nodes.filter(F.size("conditions") == 2)
    c = F.sort_array("conditions")
    return two.select(c[0]["variable"].alias("variable_a"), c[0]["bucket"].alias("bucket_a"), c[1]["variable"].alias("variable_b"), c[1]["bucket"].alias("bucket_b"), "n", F.col("net").cast("long").alias("net"))


SPACE = f"""{LEVEL1}, m AS (SELECT x.id, x.variable, x.bucket, x.pnl_cents FROM x JOIN c ON c.variable = x.variable AND c.bucket = x.bucket),
p2 AS (SELECT a.variable AS va, a.bucket AS ba, b2.variable AS vb, b2.bucket AS bb, count(*) AS n FROM m a JOIN m b2 ON a.id = b2.id AND a.variable < b2.variable GROUP BY ALL HAVING count(*) >= 100),
p3 AS (SELECT p2.va, p2.ba, p2.vb, p2.bb, z.variable AS vc, z.bucket AS bc, count(*) AS n FROM p2 JOIN m a ON a.variable = va AND a.bucket = ba JOIN m b2 ON b2.id = a.id AND b2.variable = vb AND b2.bucket = bb JOIN m z ON z.id = a.id AND z.variable > vb GROUP BY ALL)"""


@query("d2_universe", f"""{SPACE} SELECT (SELECT count(*) FROM b WHERE bucket IS NOT NULL) + (SELECT count(*) FROM c c1 JOIN c c2 ON c1.variable < c2.variable)
 + (SELECT count(*) FROM p2 JOIN c ON c.variable > p2.vb) AS universe, (SELECT count(*) FROM c) AS level1_survivors,
 (SELECT count(*) FROM c) + (SELECT count(*) FROM p2) + (SELECT count(*) FROM p3 WHERE n >= 100) AS total_matches, false AS truncated""")
def universe(spark, sf_dir) -> DataFrame:
    """How many combinations the search evaluates up to three conditions, and how many match."""
    found = discovery.discover(in_split(observations(spark, sf_dir), TRAIN), sorted(BUCKET_KEYS), OBS, min_trades=100)
    total = discovery.matches(found).count()
    return spark.createDataFrame([(found.universe, found.level1_survivors, total, found.truncated)], "universe long, level1_survivors long, total_matches long, truncated boolean")


@query("d2_triples", f"{SPACE} SELECT va AS variable_a, ba AS bucket_a, vb AS variable_b, bb AS bucket_b, vc AS variable_c, bc AS bucket_c, n FROM p3 WHERE n >= 100")
def triples(spark, sf_dir) -> DataFrame:
    found = discovery.discover(in_split(observations(spark, sf_dir), TRAIN), sorted(BUCKET_KEYS), OBS, min_trades=100)
    c = F.col("conditions")
    return found.nodes.filter(F.size("conditions") == 3).select(*(c[k][f].alias(f"{f}_{name}") for k, name in enumerate("abc") for f in ("variable", "bucket")), "n")


def _label(v: str, b: str) -> str:
    return f"{v} || '=' || format('{{:g}}', CAST({b} AS DOUBLE))"


_STATS = "count(*) AS n, sum(pnl_cents) AS s, sum(CAST(pnl_cents AS DOUBLE) * pnl_cents) AS ss"
TOP = f"""{SPACE},
e2 AS (SELECT a.variable AS va, a.bucket AS ba, b2.variable AS vb, b2.bucket AS bb, {_STATS.replace("pnl_cents", "a.pnl_cents")} FROM m a JOIN m b2 ON a.id = b2.id AND a.variable < b2.variable GROUP BY ALL),
r3 AS (SELECT p2.va, p2.ba, p2.vb, p2.bb, z.variable AS vc, z.bucket AS bc, a.id, a.pnl_cents FROM p2 JOIN m a ON a.variable = va AND a.bucket = ba JOIN m b2 ON b2.id = a.id AND b2.variable = vb AND b2.bucket = bb JOIN m z ON z.id = a.id AND z.variable > vb),
e3 AS (SELECT va, ba, vb, bb, vc, bc, {_STATS} FROM r3 GROUP BY ALL),
zu AS (SELECT [{_label("variable", "bucket")}] AS node, n, s, ss FROM (SELECT variable, bucket, {_STATS} FROM x WHERE bucket IS NOT NULL GROUP BY 1, 2)
  UNION ALL SELECT [{_label("c1.variable", "c1.bucket")}, {_label("c2.variable", "c2.bucket")}], coalesce(e2.n, 0), e2.s, e2.ss FROM c c1 JOIN c c2 ON c1.variable < c2.variable
    LEFT JOIN e2 ON va = c1.variable AND ba = c1.bucket AND vb = c2.variable AND bb = c2.bucket
  UNION ALL SELECT [{_label("p2.va", "p2.ba")}, {_label("p2.vb", "p2.bb")}, {_label("c.variable", "c.bucket")}], coalesce(e3.n, 0), e3.s, e3.ss FROM p2 JOIN c ON c.variable > p2.vb
    LEFT JOIN e3 ON e3.va = p2.va AND e3.ba = p2.ba AND e3.vb = p2.vb AND e3.bb = p2.bb AND e3.vc = c.variable AND e3.bc = c.bucket),
zt AS (SELECT *, CASE WHEN n >= 2 THEN CASE WHEN sd > 0 THEN s / n / (sd / sqrt(n)) WHEN s > 0 THEN 1e9 ELSE 0 END END AS t FROM (SELECT *, sqrt(greatest(0, ss - CAST(s AS DOUBLE) * s / nullif(n, 0)) / nullif(n - 1, 0)) AS sd FROM zu)),
pv AS MATERIALIZED (SELECT *, {p_sql("t", "n - 1")} AS p FROM zt),
zq AS MATERIALIZED (SELECT *, least(1.0, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q FROM (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM pv)),
rows_ AS (SELECT [{_label("variable", "bucket")}] AS node, id, pnl_cents FROM m UNION ALL SELECT [{_label("a.variable", "a.bucket")}, {_label("b2.variable", "b2.bucket")}], a.id, a.pnl_cents FROM m a JOIN m b2 ON a.id = b2.id AND a.variable < b2.variable
  UNION ALL SELECT [{_label("va", "ba")}, {_label("vb", "bb")}, {_label("vc", "bc")}], id, pnl_cents FROM r3),
ze AS (SELECT node, pnl_cents, row_number() OVER w - 1 AS i, sum(pnl_cents) OVER (w ROWS UNBOUNDED PRECEDING) AS eq FROM (SELECT r.*, tr.entry_ts FROM rows_ r JOIN train tr ON tr.id = r.id) WINDOW w AS (PARTITION BY node ORDER BY entry_ts, id)),
zk AS (SELECT node, count(*) FILTER (WHERE pnl_cents > 0) / nullif(count(*) FILTER (WHERE pnl_cents <> 0), 0) AS wr, sum(pnl_cents) FILTER (WHERE pnl_cents > 0) / nullif(CAST(-sum(pnl_cents) FILTER (WHERE pnl_cents < 0) AS DOUBLE), 0) AS pf, power(corr(i, eq), 2) AS r2 FROM ze GROUP BY node)
SELECT array_to_string(list_sort(q.node), ' and ') AS pattern, CAST(len(q.node) AS INT) AS depth, q.n, round(wr, 6) AS win_rate, round(pf, 6) AS profit_factor, round(r2, 6) AS equity_r2, round(q.q, 6) AS q_value
FROM zq q JOIN zk k ON k.node = q.node WHERE q.n >= 100 ORDER BY q.q, coalesce(r2, -1) DESC, pf DESC NULLS LAST, pattern LIMIT 20"""


@query("d_discover_top", TOP)
def discover_top(spark, sf_dir) -> DataFrame:
    """Patterns of up to three conditions with corrected q-values and full metrics, best first."""
    found = discovery.discover(in_split(observations(spark, sf_dir), TRAIN), sorted(BUCKET_KEYS), OBS, max_conditions=3, min_trades=100)
    return discovery.top(found, k=20).select("pattern", "depth", "n", *(F.round(c, 6).alias(c) for c in ("win_rate", "profit_factor", "equity_r2", "q_value")))


@query("i10_validate", f"""WITH {OBS_SQL}, t AS (SELECT count(*) FILTER (WHERE pnl_cents > 0) AS w, count(*) FILTER (WHERE pnl_cents <> 0) AS n FROM train WHERE {COND}),
v AS (SELECT count(*) AS c, count(*) FILTER (WHERE pnl_cents > 0) / nullif(count(*) FILTER (WHERE pnl_cents <> 0), 0) AS wr, sum(pnl_cents) / count(*) AS ex FROM validation WHERE {COND}), z AS (SELECT 1.959963984540054 AS z)
SELECT c AS n, round(wr, 6) AS win_rate, round((w / n + z * z / (2 * n) - z * sqrt(w / n * (1 - w / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS training_ci_low,
  c > 0 AND ex > 0 AND wr >= (w / n + z * z / (2 * n) - z * sqrt(w / n * (1 - w / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n) AS passed FROM t, v, z""")
def validate(spark, sf_dir) -> DataFrame:
    obs = observations(spark, sf_dir)
    d = hypotheses.decide(cohorts.cohort_metrics(in_split(obs, TRAIN), parse(TEXT), OBS), cohorts.cohort_metrics(in_split(obs, VALIDATION), parse(TEXT), OBS))
    return d.select("n", F.round("win_rate", 6).alias("win_rate"), F.round("training_ci_low", 6).alias("training_ci_low"), "passed")


@query("s14_json_projection", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_projection(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$['k']").cast("long").alias("k"))


@query("k13_promoted_key", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) // 10 AS decade, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def promoted(spark, sf_dir) -> DataFrame:
    from .operators.storage import promote

    d = promote(read(spark, sf_dir, "events"), "props", "k", "long", "mv_k")
    return d.groupBy(F.floor(F.col("mv_k") / 10).alias("decade")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("k1_insert_bars_first_wins", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def insert_first(spark, sf_dir) -> DataFrame:
    d = cohorts.dedupe(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey"], "first")
    return d.select("l_orderkey", "l_linenumber", "l_partkey")


@query("k3_insert_trades_last_wins", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def insert_last(spark, sf_dir) -> DataFrame:
    return cohorts.dedupe(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], "last").select("user_id", "event_id")


@query("k6_upsert", "WITH n AS (SELECT c_custkey, CAST(count(*) AS DOUBLE) AS fresh FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' GROUP BY 1) SELECT c_custkey, round(coalesce(fresh, c_acctbal), 2) AS v FROM customer LEFT JOIN n USING (c_custkey)")
def upsert_query(spark, sf_dir) -> DataFrame:
    from .operators.storage import upsert

    old = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    new = read(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("v"))
    new = new.join(old.select("c_custkey"), "c_custkey", "left_semi")
    return upsert(old, new, ["c_custkey"]).select("c_custkey", F.round("v", 2).alias("v"))


@query("k5_delete_by_rule", f"WITH {OBS_SQL} SELECT id FROM obs WHERE NOT coalesce(rule_id = 'F', false)")
def delete_by_rule(spark, sf_dir) -> DataFrame:
    from .operators.storage import delete_where

    return delete_where(observations(spark, sf_dir), F.col("rule_id") == "F").select("id")


@query("k8_split_overlap", "WITH s(name, role, a, b, e) AS (VALUES ('t', 'training', DATE '1995-01-01', DATE '2000-01-01', 5), ('v1', 'validation', DATE '1999-07-01', DATE '2000-06-01', 0), ('v2', 'validation', DATE '2000-01-02', DATE '2001-01-01', 0), ('v3', 'validation', DATE '2000-01-10', DATE '2002-01-01', 0)), n AS (SELECT count(*) AS c FROM orders) SELECT y.name, EXISTS (SELECT 1 FROM s x WHERE x.role = 'training' AND y.a < x.b + CAST(x.e AS INT) AND x.a < y.b + CAST(y.e AS INT)) AS overlaps, (SELECT count(*) FROM orders WHERE o_orderdate >= y.a AND o_orderdate < y.b) AS n FROM s y WHERE y.role <> 'training'")
def split_overlap(spark, sf_dir) -> DataFrame:
    rows = [("t", "training", "1995-01-01", "2000-01-01", 5), ("v1", "validation", "1999-07-01", "2000-06-01", 0), ("v2", "validation", "2000-01-02", "2001-01-01", 0), ("v3", "validation", "2000-01-10", "2002-01-01", 0)]
    table = spark.createDataFrame(rows, "name string, role string, a string, b string, embargo int").withColumn("a", F.to_date("a")).withColumn("b", F.to_date("b"))
    flagged = hypotheses.overlapping(table)
    orders = read(spark, sf_dir, "orders").select("o_orderdate")
    counts = inside(orders, "o_orderdate", flagged.select("name", "a", "b"), "a", "b").groupBy("name").agg(F.count("*").alias("n"))
    return flagged.join(counts, "name", "left").select("name", "overlaps", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("j8_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("i8_bootstrap_interval", None)
def bootstrap(spark, sf_dir) -> DataFrame:
    from .functions.stats import poisson_bootstrap

    d = in_split(observations(spark, sf_dir), TRAIN).select("rule_id", "id", "pnl_cents")
    return poisson_bootstrap(d, "pnl_cents", ["id"], by=["rule_id"])


@query("walk_forward", f"""WITH {OBS_SQL}, f AS (SELECT k, TIMESTAMP '1995-01-01' + to_months(CAST(6 * k AS INT)) AS a, TIMESTAMP '1995-01-01' + to_months(CAST(6 * k + 24 AS INT)) AS b, TIMESTAMP '1995-01-01' + to_months(CAST(6 * k + 30 AS INT)) AS c FROM range(0, 8) t(k))
SELECT k AS fold, CASE WHEN entry_ts < b THEN 'training' ELSE 'validation' END AS part, count(*) AS n, CAST(sum(pnl_cents) AS BIGINT) AS net FROM obs JOIN f ON entry_ts >= a AND entry_ts < c WHERE {COND} GROUP BY ALL""")
def walk_forward(spark, sf_dir) -> DataFrame:
    d = hypotheses.folds(observations(spark, sf_dir).filter(as_filter(parse(TEXT), OBS.column)), "1995-01-01", months=24, ahead=6, step=6, count=8)
    return d.groupBy("fold", "part").agg(F.count("*").alias("n"), F.sum("pnl_cents").alias("net"))

