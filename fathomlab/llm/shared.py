"""Where jobs keep intermediate tables, and joins against small tables of unproven size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side is broadcast only when it has been counted and has no more rows than this.
BROADCAST_ROWS = 100_000
#: Copies of the small side of a join that is too large to broadcast; the large side's hot keys spread over them.
SALTS = 16
#: Bytes of a batch that Python workers are given, so that their memory does not follow the length of texts.
BATCH_BYTES = 4 << 20
#: A key is hot if it holds this share of the rows or more, so there are at most 1 / HOT of them.
HOT = 0.001


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the session
    has it, else a temporary folder (a single machine, as in tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fathomlab-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def frugal(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most BATCH_BYTES."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def settle(df: DataFrame) -> DataFrame:
    """Run ``df`` once and cut its lineage: rows are kept in the shared folder, so that the loss of
    an executor costs nothing already computed."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spill(df: DataFrame, name: str) -> DataFrame:
    """As :func:`settle`, as a compressed Parquet table; for results that are large."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(large: DataFrame, small: DataFrame, key: str, how: str, unique: bool = False) -> DataFrame:
    """Join on one column. ``small`` (one row a key, already settled) is counted: up to
    BROADCAST_ROWS it is broadcast; beyond, ``large`` is salted so that a key holding a third of
    its rows still spreads over SALTS tasks, unless it is ``unique`` (one row a key). Spark estimates ``small`` by
    compressed files and without its copies, so a hint keeps it from being broadcast after all."""
    if small.count() <= BROADCAST_ROWS:
        return large.join(F.broadcast(small), key, how)
    if unique:
        return large.join(small.hint("merge"), key, how)
    salted = small.withColumn("__fl_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return (
        large.withColumn("__fl_salt", (F.rand(7) * SALTS).cast("int"))
        .join(salted, [key, "__fl_salt"], how)
        .drop("__fl_salt")
    )


def join_spread(large: DataFrame, small: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Inner join with ``small``, settled, one row a key, whose column ``n`` has the key's rows in
    ``large``. Rows of hot keys (at most 1 / HOT, so their list is broadcast) are dealt to SALTS tasks by
    the column ``by``; all other keys meet as they are."""
    total = small.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") >= max(1, total * HOT)
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    named = small.filter(hot).select(*keys, F.lit(True).alias("__fl_hot"))
    return (
        large.join(F.broadcast(named), keys, "left")
        .withColumn("__fl_salt", F.when(F.col("__fl_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0))
        .join(small.withColumn("__fl_salt", F.explode(salts)), [*keys, "__fl_salt"])
        .drop("__fl_hot", "__fl_salt", "n")
    )
