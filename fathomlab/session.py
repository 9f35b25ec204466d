"""Session settings, and where intermediate results are kept."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, name: str = "fathomlab") -> SparkSession:
    """A session with the settings that the operators assume: UTC, ANSI, adaptive execution."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a temporary
    one on a single machine, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fathomlab-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Run ``df`` once and cut its lineage, in the folder that the cluster shares."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
