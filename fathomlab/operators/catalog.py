"""The catalog of a research store: import batches, splits, evaluations, hypotheses, validation runs.

Every table is an append-only log of events, so that nothing that was recorded is ever rewritten; the
functions below fold a log to its present state, and :class:`Catalog` keeps the logs as Parquet.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..errors import ConfigError, ValidationError
from ..model import Split
from ..plans.guards import Registry, require_safe
from ..plans.predicates import Predicate, from_json, to_json
from .cohorts import cohort_metrics
from .hypotheses import add_split, can_validate, decide, hypothesis_id, latest_status, split_named, uses

#: Errors of an import that are kept, and rows that listings give by default (fixed values).
KEPT_ERRORS, LISTED = 100, {"bars": 3000, "trades": 500, "gaps": 30, "batches": 20}


def listed(df: DataFrame, kind: str, *order: Column) -> DataFrame:
    """The first rows of a listing, as many as its kind allows, and whether there are more: one row more
    than allowed is looked at, not the whole table."""
    most = LISTED[kind]
    some = df.orderBy(*order).limit(most + 1).withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    return some.withColumn("truncated", F.max("__n").over(Window.partitionBy()) > most).filter(F.col("__n") <= most).drop("__n")


def import_batches(log: DataFrame) -> DataFrame:
    """One row per batch of a log (batch, event: started or finished, at, source, hash, accepted, rejected,
    errors): its state, counts, and at most KEPT_ERRORS errors."""
    end = F.col("event") == "finished"
    return log.groupBy("batch").agg(
        F.max("source").alias("source"), F.max("hash").alias("hash"), F.min(F.when(~end, F.col("at"))).alias("started"), F.max(F.when(end, F.col("at"))).alias("finished"),
        F.coalesce(F.max(F.when(end, F.col("accepted"))), F.lit(0)).cast("long").alias("accepted"), F.coalesce(F.max(F.when(end, F.col("rejected"))), F.lit(0)).cast("long").alias("rejected"),
        F.slice(F.coalesce(F.max(F.when(end, F.col("errors"))), F.array().cast("array<string>")), 1, KEPT_ERRORS).alias("errors"),
    ).withColumn("status", F.when(F.col("finished").isNull(), "running").otherwise("finished"))


def batches_by_hash(log: DataFrame, hashes: DataFrame) -> DataFrame:
    """The latest finished batch of each hash of ``hashes``; a batch that never finished does not count."""
    done = import_batches(log).filter("status = 'finished'").join(hashes.select("hash").distinct(), "hash")
    w = Window.partitionBy("hash").orderBy(F.col("finished").desc(), F.col("batch").desc())
    return done.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def hypotheses(created: DataFrame, statuses: DataFrame) -> DataFrame:
    """Each hypothesis (hypothesis, name, predicate, at, seq) with its latest status."""
    last = latest_status(statuses).select("hypothesis", "status")
    return created.join(last, "hypothesis", "left").withColumn("status", F.coalesce("status", F.lit("training_passed")))


def validation_runs(log: DataFrame, hypothesis: str | None = None) -> DataFrame:
    """Runs, newest first."""
    return (log if hypothesis is None else log.filter(F.col("hypothesis") == hypothesis)).orderBy(F.col("at").desc(), F.col("seq").desc())


_LOGS = {
    "batches": "batch string, event string, at timestamp_ntz, source string, hash string, accepted long, rejected long, errors array<string>, seq long",
    "splits": "name string, role string, start timestamp_ntz, end timestamp_ntz, embargo int, deleted boolean, at timestamp_ntz, seq long",
    "evaluations": "split string, role string, at timestamp_ntz, seq long",
    "hypotheses": "hypothesis string, name string, predicate string, metrics string, at timestamp_ntz, seq long",
    "statuses": "hypothesis string, status string, at timestamp_ntz, seq long",
    "runs": "hypothesis string, split string, passed boolean, reason string, p_value double, q_value double, metrics string, at timestamp_ntz, seq long",
}


class Catalog:
    """The logs under ``root``. Small driver-side orchestration; cohorts are evaluated by Spark."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self, table: str) -> DataFrame:
        try:
            return self.spark.read.schema(_LOGS[table]).parquet(f"{self.root}/{table}")
        except Exception as error:  # nothing was recorded yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], _LOGS[table])

    def _append(self, table: str, **values) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        row = values | {"at": now, "seq": time.time_ns()}  # of any writer, without a look at the log
        names = [f.split()[0] for f in _LOGS[table].split(", ")]
        self.spark.createDataFrame([tuple(row.get(n) for n in names)], _LOGS[table]).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    # imports

    def start_batch(self, source: str, file_hash: str) -> str:
        batch = uuid.uuid4().hex
        self._append("batches", batch=batch, event="started", source=source, hash=file_hash)
        return batch

    def finish_batch(self, batch: str, accepted: int, rejected: int, errors: list[str]) -> None:
        self._append("batches", batch=batch, event="finished", accepted=accepted, rejected=rejected, errors=errors[:KEPT_ERRORS])

    def batch_by_hash(self, file_hash: str) -> str | None:
        found = batches_by_hash(self.log("batches"), self.spark.createDataFrame([(file_hash,)], "hash string")).first()
        return found["batch"] if found else None

    def batches(self) -> DataFrame:
        return listed(import_batches(self.log("batches")), "batches", F.col("started").desc(), F.col("batch"))

    # splits

    def splits(self) -> list[Split]:
        w = Window.partitionBy("name").orderBy(F.col("seq").desc())
        rows = self.log("splits").withColumn("__n", F.row_number().over(w)).filter("__n = 1 AND NOT deleted").orderBy("start", "name").collect()
        return [Split(r["name"], r["role"], r["start"], r["end"], r["embargo"]) for r in rows]

    def create_split(self, split: Split) -> None:
        add_split(self.splits(), split)
        self._append("splits", name=split.name, role=split.role, start=split.start, end=split.end, embargo=split.embargo_days, deleted=False)

    def split(self, name: str) -> Split:
        return split_named(self.splits(), name)

    def delete_split(self, name: str) -> None:
        s = self.split(name)
        self._append("splits", name=name, role=s.role, start=s.start, end=s.end, embargo=s.embargo_days, deleted=True)

    def record_evaluation(self, split: Split) -> tuple[int, str | None]:
        """Counts one more evaluation of a split; how many there are now, and the warning they earn."""
        self._append("evaluations", split=split.name, role=split.role)
        r = uses(self.log("evaluations").filter(F.col("split") == split.name)).first()
        return r["evaluations"], r["warning"]

    # hypotheses

    def save(self, name: str, predicate: Predicate, registry: Registry, obs: DataFrame, split: Split) -> str:
        """Record a hypothesis with its metrics on a split: only of what is known at entry, and not of an
        empty cohort; names are unique."""
        from ..sources.views import in_split

        require_safe(predicate, registry, "hypothesis")
        if not self.log("hypotheses").filter(F.col("name") == name).isEmpty():
            raise ValidationError(f"a hypothesis named {name} exists")
        metrics = cohort_metrics(in_split(obs, split), predicate, registry).first().asDict()
        if not metrics["n"]:
            raise ValidationError("no row of the split meets the condition")
        key = hypothesis_id(name)
        self._append("hypotheses", hypothesis=key, name=name, predicate=to_json(predicate), metrics=json.dumps(metrics, default=str))
        self._append("statuses", hypothesis=key, status="training_passed")
        return key

    def hypotheses(self) -> DataFrame:
        return hypotheses(self.log("hypotheses"), self.log("statuses"))

    def hypothesis(self, key: str):
        found = self.hypotheses().filter((F.col("hypothesis") == key) | (F.col("name") == key)).first()
        if found is None:
            raise ConfigError(f"no hypothesis {key}")
        return found

    def set_status(self, key: str, status: str) -> None:
        self._append("statuses", hypothesis=self.hypothesis(key)["hypothesis"], status=status)

    def validate(self, key: str, split: Split, registry: Registry, obs: DataFrame, training: Split, confirmed: bool = False):
        """Run a hypothesis once on a split that is not for training, store the run, settle the status and
        count the use. Without ``confirmed`` nothing is looked at: a validation split is spent by looking."""
        from ..sources.views import in_split

        h = self.hypothesis(key)
        can_validate(h["status"], split.role)
        if not confirmed:
            raise ValidationError(f"validating {h['name']} on {split.name} uses it up; confirm to go on")
        p = from_json(h["predicate"])
        r = decide(cohort_metrics(in_split(obs, training), p, registry), cohort_metrics(in_split(obs, split), p, registry)).first()
        self._append("runs", hypothesis=h["hypothesis"], split=split.name, passed=r["passed"], reason=r["reason"], p_value=r["p_value"], q_value=r["p_value"], metrics=json.dumps(r.asDict(), default=str))
        self.set_status(h["hypothesis"], "validated" if r["passed"] else "rejected")
        self.record_evaluation(split)
        return r

    def runs(self, key: str | None = None) -> DataFrame:
        return validation_runs(self.log("runs"), key)
