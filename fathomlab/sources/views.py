"""The library's relations derived from the star-schema test tables: observations and bars."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..model import Binning, Split, Variable
from ..plans.guards import Registry


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What is known of the observations' columns.
OBS = Registry.of(
    Variable("obs.priority", "f_priority", "categorical"),
    Variable("obs.segment", "f_segment", "categorical"),
    Variable("obs.dow", "f_dow", "categorical"),
    Variable("obs.direction", "direction", "categorical"),
    Variable("obs.balance", "f_balance", binning=Binning("quantile", count=5)),
    Variable("obs.lines", "f_lines", binning=Binning("edges", edges=(2.0, 4.0, 6.0))),
    Variable("obs.quantity", "f_quantity", binning=Binning("width", width=50.0)),
    Variable("obs.discount", "f_discount", binning=Binning("quantile", count=4)),
    Variable("obs.shippedDays", "f_shipped_days", causality="outcome"),
    Variable("obs.year", "f_year", causality="meta"),
)
TRAIN = Split("train", "training", datetime(1995, 1, 1), datetime(2000, 1, 1), 5)
VALIDATION = Split("validation", "validation", datetime(2000, 1, 10), datetime(2002, 1, 1), 5)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per order, with an outcome in whole cents and features that may be null."""
    orders, customer, lineitem = (read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    lines = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").cast("double").alias("f_lines"),
        F.sum("l_quantity").alias("f_quantity"),
        F.round(F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count("*") / 100, 4).alias("f_discount"),
        F.max("l_shipdate").alias("last_ship"),
    )
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    place = F.lit(None).cast("double")
    for k, name in enumerate(segments):
        place = F.when(F.col("c_mktsegment") == name, float(k)).otherwise(place)
    return (
        orders.join(customer.select("c_custkey", "c_acctbal", "c_mktsegment"), orders.o_custkey == F.col("c_custkey"), "left")
        .join(lines, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("entry_ts"),
            F.when(F.col("o_orderkey") % 17 == 0, F.lit(0).cast("long")).otherwise(F.round(F.col("o_totalprice") * 100).cast("long") - 25000000).alias("pnl_cents"),
            F.col("o_orderstatus").alias("rule_id"), F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(-1).alias("direction"),
            F.substring("o_orderpriority", 1, 1).cast("double").alias("f_priority"), place.alias("f_segment"),
            (F.weekday("o_orderdate") + 1).cast("double").alias("f_dow"), F.col("c_acctbal").alias("f_balance"),
            "f_lines", "f_quantity", "f_discount",
            F.datediff("last_ship", "o_orderdate").cast("double").alias("f_shipped_days"), F.year("o_orderdate").cast("double").alias("f_year"),
        )
    )


def bars_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type: an instrument per type, first and last by (ts, event_id)."""
    events = read(spark, sf_dir, "events")
    at = F.struct("ts", "event_id")
    return events.groupBy(F.col("event_type").alias("instrument"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"),
        F.count("*").cast("double").alias("tick_volume"), F.lit(0.0).alias("volume"), F.lit(1.0).alias("spread"),
    )


def in_split(df: DataFrame, split: Split, ts: str = "entry_ts") -> DataFrame:
    """The half-open range of a split."""
    return df.filter((F.col(ts) >= F.lit(split.start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(split.end).cast("timestamp_ntz")))


def latest_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row per key by ``order``."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
