"""Changes to stored tables, as rewrites that Spark distributes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import settle


def insert_new(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``incoming`` to append: the first per key by ``order``, keys not stored yet. Running it
    again gives nothing, so an import can be repeated."""
    w = Window.partitionBy(*key).orderBy(*order)
    fresh = incoming.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return fresh.join(existing.select(*key), key, "left_anti").select(*incoming.columns)


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], preserve: list[str] | None = None) -> DataFrame:
    """New rows replace old ones by key; columns in ``preserve`` keep the stored value where there is one."""
    rest = [c for c in existing.columns if c not in key]
    o = existing.select(*key, *(F.col(c).alias(f"__o_{c}") for c in rest), F.lit(True).alias("__old"))
    n = incoming.select(*key, *(F.col(c).alias(f"__n_{c}") for c in rest if c in incoming.columns), F.lit(True).alias("__new"))
    d = o.join(n, key, "full")

    def value(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(f"__o_{c}")
        old, new = F.col(f"__o_{c}"), F.col(f"__n_{c}")
        if c in (preserve or []):
            return F.when(F.col("__old"), old).otherwise(new)
        return F.when(F.col("__new"), new).otherwise(old)

    return d.select(*key, *(value(c).alias(c) for c in rest))


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def update_features(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    c = changes.select(key, F.col(column).alias("__new"))
    return df.join(c, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new").select(*df.columns)


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    """The table at ``path``, None if there is none yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def replace_stored(path: str, incoming: DataFrame, key: list[str], order: list[str], partition_by: list[str]) -> None:
    """Put ``incoming`` (the last row of a key by ``order``) into a partitioned Parquet table, in place of rows with its keys. Only
    partitions that take or lose a row are written, each by a swap of whole partitions; all others keep their files. Safe to
    repeat: a run after one that failed gives the same table."""
    spark = incoming.sparkSession
    last = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    new = settle(incoming.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n"))
    old = stored(spark, path, incoming)
    if old is None:
        _swap(new, path, partition_by)
        return
    left = old.join(new.select(*key), key, "left_semi").select(*partition_by)  # a key may have moved
    touched = settle(left.union(new.select(*partition_by)).distinct())
    stay = old.join(touched, partition_by, "left_semi").join(new.select(*key), key, "left_anti").select(*new.columns)
    rows = settle(stay.unionByName(new))
    _swap(rows, path, partition_by)
    _remove_empty(touched.join(rows.select(*partition_by).distinct(), partition_by, "left_anti"), path, partition_by)


def delete_stored(path: str, like: DataFrame, condition: Column, partition_by: list[str]) -> int:
    """Delete the rows for which ``condition`` is true; only their partitions are written. The number of rows deleted."""
    old = stored(like.sparkSession, path, like)
    if old is None:
        return 0
    hit = F.coalesce(condition, F.lit(False))
    touched = settle(old.filter(hit).groupBy(*partition_by).agg(F.count("*").alias("__n")))
    n = touched.agg(F.sum("__n")).first()[0] or 0
    if n:
        rows = settle(old.join(touched.drop("__n"), partition_by, "left_semi").filter(~hit).select(*like.columns))
        _swap(rows, path, partition_by)
        _remove_empty(touched.drop("__n").join(rows.select(*partition_by).distinct(), partition_by, "left_anti"), path, partition_by)
    return n


def _swap(rows: DataFrame, path: str, partition_by: list[str]) -> None:
    rows.repartition(*partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def _remove_empty(gone: DataFrame, path: str, partition_by: list[str]) -> None:
    """Drop partitions that have no row left: a swap does not see them."""
    spark = gone.sparkSession
    folders = gone.select(F.concat_ws("/", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in partition_by)).alias("f"))
    for r in folders.collect():  # partitions that were emptied
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{r['f']}")
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def promoted_name(key: str) -> str:
    return "mv_" + re.sub(r"[^A-Za-z0-9]", "_", key)


def promote(df: DataFrame, json_column: str, key: str, kind: str, name: str | None = None) -> DataFrame:
    """A JSON key as a column of its own: stored so, scans prune and skip by it."""
    return df.withColumn(name or promoted_name(key), F.get_json_object(json_column, f"$['{key}']").cast(kind))


def write_clustered(df: DataFrame, path: str, by: list[str], partition_by: list[str] | None = None) -> None:
    """Range-partition and sort by ``by``, so that row groups have narrow minima and maxima."""
    out = df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def analyze(spark, table: str) -> None:
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
