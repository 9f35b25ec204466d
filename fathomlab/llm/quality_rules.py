"""Quality rules with host verdicts.

Each document is measured (words, word characters, symbols, repeated lines, words in repeated
five-word windows). Rule failures are then pooled by host: a host's failure rate is shrunk towards
the corpus by an empirical beta prior (method of moments over hosts), and hosts whose shrunken rate
reaches a limit take all their documents with them.

Defined results: a null text counts as one without words (it fails the length rule). Rows whose
host is null belong to no host: only their own rules decide. Repeated rows are measured and counted
one by one. An empty table gives an empty result. Columns beside ``text`` and the host column are
passed through untouched by :func:`apply_quality_rules`; working columns start with ``__fl_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import join_counted, settle
from .textops import IS_SPACE, Text, mix, per_row, scramble, slices, windows

#: Production parameters.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
WORD_CHARS = (2, 12)
HOST_LIMIT = 0.5
WINDOW = 5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _repeated(keys: np.ndarray, later_only: bool) -> np.ndarray:
    """Marks keys that occur twice or more; with ``later_only`` not their first occurrence."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    mark = np.zeros(len(keys), bool)
    mark[order[1:][same]] = True
    if not later_only:
        mark[order[:-1][same]] = True
    return mark


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The MEASURES of each text of a string column."""
    text = Text(column)
    words = text.segments(IS_SPACE)
    lead = (text.data & 0xC0) != 0x80
    salt = scramble(text.n)

    lines = text.segments(_NEWLINE)
    line_words = np.add.reduceat(~IS_SPACE[text.data], lines.starts) if len(lines.starts) else np.zeros(0, np.int64)
    worded = line_words > 0
    dup = np.zeros(len(worded), bool)
    dup[worded] = _repeated(mix(lines.names()[worded] ^ salt[lines.rows()[worded]]), later_only=True)

    names, rows = words.names(), words.rows()
    starts, window = windows(names, words.ptr, WINDOW)
    twice = starts[_repeated(mix(window ^ salt[rows[starts]]), later_only=False)]
    edge = np.zeros(len(names) + WINDOW + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    covered = np.cumsum(edge)[: len(names)] > 0
    return {
        "n_words": words.counts(),
        "word_chars": text.sums(lead & ~words.sep),
        "n_symbols": text.sums(_SYMBOL[text.data]),
        "n_lines": per_row(worded.astype(np.int64), lines.ptr),
        "n_dup_lines": per_row(dup.astype(np.int64), lines.ptr),
        "n_repeat_words": per_row(covered.astype(np.int64), words.ptr),
    }


def with_measures(docs: DataFrame, keep: list[str], prefix: str = "") -> DataFrame:
    """``keep`` columns of ``docs`` and the MEASURES of its ``text``; one pass, no shuffle."""
    need = docs.select(*keep, *(["text"] if "text" not in keep else []))
    schema = T.StructType([*(need.schema[c] for c in keep), *(T.StructField(prefix + m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = measure(batch.column(batch.schema.get_field_index("text")))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(found[m], pa.int64()) for m in MEASURES)], [*keep, *(prefix + m for m in MEASURES)])

    return need.mapInArrow(run, schema)


def base_failed(p: str = "") -> F.Column:
    """The document's own verdict: too short, or too many words in repeated windows."""
    return (F.col(p + "n_words") < MIN_WORDS) | (100 * F.col(p + "n_repeat_words") > MAX_REPEAT_PERCENT * F.col(p + "n_words"))


def any_failed(p: str = "") -> F.Column:
    """Whether any rule fails; what is pooled by host."""
    n = F.col(p + "n_words")
    return (
        base_failed(p)
        | (100 * F.col(p + "n_symbols") > MAX_SYMBOL_PERCENT * n)
        | (100 * F.col(p + "n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col(p + "n_lines"))
        | (F.col(p + "word_chars") < WORD_CHARS[0] * n)
        | (F.col(p + "word_chars") > WORD_CHARS[1] * n)
    )


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = HOST_LIMIT, p: str = "") -> DataFrame:
    """One row per host: n, failures, shrunken ``host_rate`` and ``host_rejected``. The prior is
    beta with the corpus mean m and strength m(1-m)/v - 1 (within 1 and 1e6), v being the variance
    of host rates weighted by their documents."""
    hosts = settle(
        measured.filter(F.col(host).isNotNull())
        .groupBy(host)
        .agg(F.count("*").alias("host_docs"), F.sum(any_failed(p).cast("long")).alias("host_failures"))
    )
    n, f = F.col("host_docs"), F.col("host_failures")
    row = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff")).first()
    total = row["n"] or 1
    m = (row["f"] or 0) / total
    v = max(0.0, (row["ff"] or 0.0) / total - m * m)
    strength = min(1e6, max(1.0, m * (1 - m) / v - 1)) if v > 1e-12 else 1e6
    rate = (f + m * strength) / (n + strength)
    return hosts.withColumn("host_rate", F.round(rate, 6)).withColumn("host_rejected", F.round(rate, 6) >= limit)


def quality_report(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Measures and verdicts of every row: doc_id, MEASURES, base_failed, host_rate, kept."""
    measured = settle(with_measures(docs, ["doc_id", host]))
    hosts = host_verdicts(measured, host, limit).select(host, "host_rate", "host_rejected")
    return (
        join_counted(measured, hosts, host, "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))
        .select("doc_id", *MEASURES, "base_failed", "host_rate", "kept")
    )


def apply_quality_rules(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that neither their own rules nor their host's verdict reject, with the
    columns they came with."""
    columns = docs.columns
    hosts = host_verdicts(with_measures(docs, [host], "__fl_"), host, limit, "__fl_")
    rejected = settle(hosts.filter("host_rejected").select(F.col(host).alias("__fl_host")))
    kept = with_measures(docs, columns, "__fl_").filter(~base_failed("__fl_")).withColumn("__fl_host", F.col(host))
    return join_counted(kept, rejected, "__fl_host", "left_anti").select(*columns)
