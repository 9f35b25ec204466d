"""Hypotheses, splits and validation: small tables and the rules between them."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..errors import ConfigError, ValidationError
from ..model import Split
from .intervals import overlaps

SOFT_USES, HARD_USES = 10, 20


def decide(training: DataFrame, validation: DataFrame) -> DataFrame:
    """Whether one row of validation metrics upholds one row of training metrics: it has rows, its win
    rate is not below the training interval, and its expectancy is above 0."""
    t = training.select(F.col("ci_low").alias("training_ci_low"), F.col("ci_high").alias("training_ci_high"))
    d = validation.join(F.broadcast(t))
    reason = (
        F.when(F.col("n") == 0, "no rows")
        .when(F.col("training_ci_low").isNull() | F.col("training_ci_high").isNull() | F.col("win_rate").isNull(), "no interval")
        .when(F.col("win_rate") < F.col("training_ci_low"), "win rate below the training interval")
        .when(~(F.col("expectancy") > 0), "expectancy not above 0")
    )
    return d.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())


def overlapping(splits: DataFrame) -> DataFrame:
    """Splits (name, role, a, b, embargo) that are not for training, and whether each overlaps a training split once
    each end is pushed out by its embargo."""
    end = F.date_add("b", F.col("embargo")).alias("end")
    t = splits.filter("role = 'training'").select(F.col("a").alias("ta"), F.date_add("b", F.col("embargo")).alias("tb"))
    v = splits.filter("role <> 'training'")
    near = overlaps(v.select("name", "a", end), t, "a", "end", "ta", "tb").select("name").distinct().withColumn("hit", F.lit(True))
    return v.join(near, "name", "left").withColumn("overlaps", F.coalesce("hit", F.lit(False))).drop("hit")


def add_split(existing: list[Split], new: Split) -> list[Split]:
    if not new.start < new.end:
        raise ValidationError(f"split {new.name} is empty")
    if any(s.name == new.name for s in existing):
        raise ValidationError(f"split {new.name} exists")
    if new.role != "training":
        for s in existing:
            if s.role == "training" and s.overlaps(new):
                raise ValidationError(f"split {new.name} overlaps {s.name} or its embargo")
    return sorted([*existing, new], key=lambda s: s.start)


def split_named(existing: list[Split], name: str) -> Split:
    for s in existing:
        if s.name == name:
            return s
    raise ConfigError(f"no split {name}")


def uses(log: DataFrame) -> DataFrame:
    """Evaluations per split from an append-only log, and the warning that they earn."""
    n = F.col("evaluations")
    return log.groupBy("split", "role").agg(F.count("*").alias("evaluations")).withColumn(
        "warning", F.when(F.col("role") == "training", F.lit(None)).when(n > HARD_USES, "hard").when(n > SOFT_USES, "soft")
    )


def latest_status(log: DataFrame) -> DataFrame:
    """Current state per hypothesis of an append-only log (hypothesis, status, at, seq)."""
    w = Window.partitionBy("hypothesis").orderBy(F.col("at").desc(), F.col("seq").desc())
    return log.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def folds(df: DataFrame, start: str, months: int, ahead: int, step: int, count: int, ts: str = "entry_ts") -> DataFrame:
    """Walk-forward: each row with every fold that it falls in, as training or validation."""
    at = lambda m: F.add_months(F.lit(start).cast("date"), m).cast("timestamp_ntz")
    each = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("fold", F.col("fold").cast("long"))
    begin, turn, end = (at((F.col("fold") * step + k).cast("int")) for k in (0, months, months + ahead))
    return each.filter((F.col(ts) >= begin) & (F.col(ts) < end)).withColumn("part", F.when(F.col(ts) < turn, "training").otherwise("validation"))


@dataclass(frozen=True)
class Hypothesis:
    id: str
    name: str
    predicate: str
    status: str = "training_passed"


def hypothesis_id(name: str) -> str:
    """A slug: accents off, lower case, runs of other characters as one dash."""
    plain = unicodedata.normalize("NFD", name).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-") or "hypothesis"


def can_validate(status: str, role: str) -> None:
    if role == "training":
        raise ValidationError("a hypothesis is not validated on a training split")
    if status in ("validated", "rejected"):
        raise ValidationError(f"the hypothesis is already {status}")
