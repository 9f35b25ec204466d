"""The corpus pipeline: five operators of ``fathomlab.llm``, each working on all that the stage
before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
``documents``; the last adds each document's token ids, their number and the decoded text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomlab.llm.decontamination import drop_contaminated
from fathomlab.llm.near_dedup import drop_near_duplicates
from fathomlab.llm.pii import mask_pii
from fathomlab.llm.quality_rules import apply_quality_rules
from fathomlab.llm.sentencepiece_codec import encode_decode
from fathomlab.llm.shared import frugal, spill


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host fails them, go."""
    frugal(spark)
    return apply_quality_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    frugal(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return drop_contaminated(docs, frugal(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked in the text."""
    frugal(spark)
    return mask_pii(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text that they decode to."""
    frugal(spark)
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("sentencepiece", tokens)]

#: Weighted sampling, retrieval and span models have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spill(docs, f"pipeline-{k}")
    return docs
