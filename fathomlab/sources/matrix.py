"""Features stored as JSON objects, as a typed matrix: a column of doubles for each key that occurs.

A value counts if it is a finite number, or text that reads as one; null, empty text and all else are null. A missing
outcome is 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import ValidationError

#: Keys that a matrix can have; more mean that the objects are no features.
MOST_KEYS = 10_000


def finite(c: Column) -> Column:
    x = c.try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)  # also null for what is no number


def column_of(key: str) -> str:
    return key.replace(".", "_")


def keys_of(df: DataFrame, column: str) -> DataFrame:
    """key, kind, n, n_numbers of every key of the objects: ``number`` if each value that is not empty is one, ``text`` if none is, else
    ``mixed``. One grouping, with partial sums."""
    pairs = df.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
    n, numbers = F.count_if(F.col("value").isNotNull() & (F.col("value") != "")), F.count_if(finite(F.col("value")).isNotNull())
    kind = F.when(numbers == n, "number").when(numbers == 0, "text").otherwise("mixed")
    return pairs.groupBy("key").agg(kind.alias("kind"), n.alias("n"), numbers.alias("n_numbers"))


def feature_matrix(df: DataFrame, column: str, keep: Iterable[str] = (), pnl: str | None = None, keys: Iterable[str] | None = None) -> DataFrame:
    """``keep`` and one column of doubles for each of ``keys`` (all that occur, in order, unless given; ``a.b`` is a column ``a_b``). Each
    object is parsed once."""
    if keys is None:
        rows = keys_of(df, column).select("key").orderBy("key").limit(MOST_KEYS + 1).collect()
        if len(rows) > MOST_KEYS:
            raise ValidationError(f"more than {MOST_KEYS} keys")
        keys = [r["key"] for r in rows]
    keys, keep = list(keys), list(keep)
    names = [column_of(k) for k in keys]
    if len({*names, *keep}) < len(names) + len(keep):
        raise ValidationError("two columns have one name")
    if not keys:
        return df.select(*keep)
    parsed = df.withColumn("__f", F.from_json(column, ", ".join(f"`{k}` string" for k in keys)))
    kept = [F.coalesce(c, F.lit(0)).alias(c) if c == pnl else F.col(c) for c in keep]
    return parsed.select(*kept, *(finite(F.col("__f").getField(k)).alias(n) for k, n in zip(keys, names)))


def null_counts(matrix: DataFrame, columns: Iterable[str]) -> DataFrame:
    """variable, n, nulls of each column, from one aggregation."""
    columns = list(columns)
    row = matrix.agg(F.count("*").alias("__n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col("__n").alias("n"), F.col(c).alias("nulls")) for c in columns))).alias("v")).select("v.*")


def matrix_from_rows(spark: SparkSession, rows: Iterable[Mapping], variables: Iterable[str], keep: Mapping[str, str]) -> DataFrame:
    """A matrix of rows at hand, by the same rules: ``keep`` are columns with their types, ``variables`` keys of the mappings."""
    variables = list(variables)
    schema = ", ".join([*(f"{c} {t}" for c, t in keep.items()), *(f"`{column_of(v)}` string" for v in variables)])
    text = lambda v: None if v is None else str(float(v)) if isinstance(v, (bool, int, float)) else str(v)
    data = [tuple([r.get(c) for c in keep] + [text(r.get(v)) for v in variables]) for r in rows]
    return spark.createDataFrame(data, schema).select(*keep, *(finite(F.col(column_of(v))).alias(column_of(v)) for v in variables))
