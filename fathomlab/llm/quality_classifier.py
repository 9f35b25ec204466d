"""Quality classifier by co-training.

Two views of a document: its *content* (hashed words, word shapes and the layout of the whole text) and
its *page metadata* (host, language and size, from the columns source, lang and n_chars). A logistic
classifier of each view starts from labelled documents. Then, for ROUNDS rounds, every unlabelled document
is scored by both views, each view picks the HANDED documents it is surest of, and hands them, with its
pseudo-labels, to the other view alone; a view never learns from what it picked itself. The views are
calibrated on one half of labelled documents held back from both and combined by a logistic regression on
the other half, and every document is scored in one pass.

What the views read of a document (see FEATURES) is made in one pass over the texts and kept in the shared folder:
the cell of each of its words and shapes in two bytes, its layout and the cells of its metadata. Every round and
the last scoring read that, not the texts.

Labelled documents for fitting are a bounded sample (LABELLED per class); the unlabelled documents that are
scored and searched for the surest are all of them, in Spark, and only those picked reach the driver.

Defined results: null texts are empty texts; a null host, language or size is a value of its own (so is a
column that is not there); without
labels of both classes every score is 0.5; several labels of one doc_id count as good only if all
are; labels that are null or lack a document are ignored. A document is kept if its score is KEEP or
more.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .models import Bags, bounded, dense_logistic, logistic, sigmoid
from .quality_rules import measure
from .shared import join_counted, settle, spill
from .textops import IS_SPACE, Text, mix, slices

LABELLED = 1500
ROUNDS = 3
#: Pseudo-labels that each view hands over per round, and the least confidence for them.
HANDED, SURE = 200, 0.95
KEEP = 0.5
WORDS = 1 << 15  # a cell has two bytes
HOSTS = 1 << 12

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _word_cells(words) -> np.ndarray:
    """A word's cell: half of the cells are for words, half for shapes (the kind of its first byte and
    its last two, and its length)."""
    names = words.names()
    data, a, z = words.text.data, words.starts, words.starts + words.lens - 1
    kind = np.zeros(256, np.int64)
    kind[_UPPER], kind[_DIGIT], kind[_PUNCT] = 1, 2, 3
    kind[0x80:] = 4
    last = np.where(kind[data[z]] == 3, 5 + data[z].astype(np.int64), kind[data[z]])
    shape = ((kind[data[a]] * 5 + kind[data[np.maximum(z - 1, a)]]) * 140 + last) * 8 + np.minimum(words.lens // 3, 7)
    half = WORDS // 2
    return np.stack([(names & np.uint64(half - 1)).astype(np.int64), half + (mix(shape.astype(np.uint64)) & np.uint64(half - 1)).astype(np.int64)])


def layout(column: pa.Array) -> np.ndarray:
    """Numbers of a page's layout, one row per text."""
    text = Text(column)
    size = np.maximum(text.sums(~IS_SPACE[text.data]), 1)
    m = measure(column)
    words, lines = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1)
    return np.column_stack([
        np.log1p(m["n_words"]) / 10, np.minimum(m["n_words"], 20) / 20, np.log1p(words / lines) / 5, m["word_chars"] / words / 10, m["n_dup_lines"] / lines,
        m["n_repeat_words"] / words, np.minimum(m["n_symbols"] / words, 2), text.sums(_UPPER[text.data]) / size, text.sums(_DIGIT[text.data]) / size,
        text.sums(_PUNCT[text.data]) / size,
    ])


N_LAYOUT = 10


def _meta_cells(hosts: list, langs: list, sizes: list) -> np.ndarray:
    cell = lambda kind, x: zlib.crc32(repr((kind, x)).encode()) % HOSTS
    grade = lambda n: None if n is None else int(2 * math.log2(max(n, 0) + 1))
    return np.array([[cell("host", h), cell("lang", x), cell("size", grade(n))] for h, x, n in zip(hosts, langs, sizes)], np.int64).reshape(-1, 3)


def _source(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the metadata (null where a column is not there)."""
    have = lambda c, kind: (F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)).alias(c)
    return docs.select("doc_id", "text", have("source", "string"), have("lang", "string"), have("n_chars", "long"))


#: ``words`` and ``shapes`` hold a cell of two bytes for each word, in the text's order.
FEATURES = "doc_id long, words binary, shapes binary, layout array<double>, meta array<long>"


def _fixed(a: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(a.reshape(-1)), a.shape[1]).cast(pa.list_(pa.from_numpy_dtype(a.dtype)))


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FEATURES of rows as :func:`_source` gives them."""
    for batch in slices(batches):
        words = Text(batch.column(1)).segments(IS_SPACE)
        cells = _word_cells(words) if len(words.starts) else np.zeros((2, 0), np.int64)
        ptr = pa.py_buffer((2 * words.ptr).astype(np.int32))
        names, shapes = (pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ptr, pa.py_buffer(x.astype("<u2"))]) for x in cells)
        meta = _meta_cells(*(batch.column(k).to_pylist() for k in (2, 3, 4)))
        yield pa.RecordBatch.from_arrays([batch.column(0), names, shapes, _fixed(layout(batch.column(1))), _fixed(meta)], ["doc_id", "words", "shapes", "layout", "meta"])


def _cells_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a column of FEATURES, row after row, and their number in each row."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if off[-1] else b""
    return np.frombuffer(raw, "<u2", int(off[-1] - off[0]) // 2, int(off[0])).astype(np.int64), np.diff(off) // 2


def features(docs: DataFrame) -> DataFrame:
    """FEATURES of every row of ``docs``, made once and kept."""
    return spill(_source(docs).mapInArrow(_made, FEATURES), "quality")


class CoTrained:
    """Weights of both views and of their combination."""

    def __init__(self):
        self.words, self.words_b = np.zeros(WORDS + 2 * N_LAYOUT), 0.0
        self.meta, self.meta_b = np.zeros(HOSTS), 0.0
        self.mean, self.scale = np.zeros(N_LAYOUT), np.ones(N_LAYOUT)
        self.text_fit = self.meta_fit = np.array([1.0, 0.0])
        self.both = np.array([1.0, 1.0, 0.0])

    def content(self, batch: pa.RecordBatch) -> np.ndarray:
        x = (np.asarray(batch.column(3).flatten()).reshape(-1, N_LAYOUT) - self.mean) / self.scale
        out = np.concatenate([x, x * x], axis=1) @ self.words[WORDS:] + self.words_b
        (words, n), (shapes, _) = _cells_of(batch.column(1)), _cells_of(batch.column(2))
        return out + np.bincount(np.repeat(np.arange(len(n)), n), self.words[words] + self.words[shapes], minlength=len(n)) / np.maximum(n, 1)

    def metadata(self, batch: pa.RecordBatch) -> np.ndarray:
        return self.meta[np.asarray(batch.column(4).flatten()).reshape(-1, 3)].sum(axis=1) + self.meta_b

    def combined(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated views and the final score."""
        a, b = self.text_fit[0] * a + self.text_fit[1], self.meta_fit[0] * b + self.meta_fit[1]
        return sigmoid(a), sigmoid(b), sigmoid(np.clip(a, -10, 10) * self.both[0] + np.clip(b, -10, 10) * self.both[1] + self.both[2])


class Learner:
    """The driver's side of co-training: features of the labelled sample and of handed documents. A row has
    cells, counts, layout and meta (cells of the metadata)."""

    def __init__(self, rows: list[dict], share: float):
        self.model, self.share = CoTrained(), share
        self.held, self.rows = rows[::4], [r for k, r in enumerate(rows) if k % 4]
        x = np.array([r["layout"] for r in self.rows])
        self.model.mean, self.model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.handed: list[list[tuple[dict, float]]] = [[], []]  # what each view has been given

    def _bags(self, view: int, part: list[dict]) -> Bags:
        if view:
            return Bags([(np.asarray(r["meta"]), np.ones(len(r["meta"]))) for r in part])
        out = []
        for r in part:
            z = (np.array(r["layout"]) - self.model.mean) / self.model.scale
            words = np.asarray(r["counts"], float) / max(1, sum(r["counts"]) / 2)
            out.append((np.concatenate([r["cells"], WORDS + np.arange(2 * N_LAYOUT)]), np.concatenate([words, z, z * z])))
        return Bags(out)

    def fit(self, view: int, steps: int) -> None:
        """Learn a view from the labels and from what the other view handed over."""
        part = self.rows + [r for r, _ in self.handed[view]]
        y = np.array([r["label"] for r in self.rows] + [v for _, v in self.handed[view]], float)
        weight = np.concatenate([np.ones(len(self.rows)), np.full(len(self.handed[view]), 0.5)])
        w, b = logistic(self._bags(view, part), y, (WORDS + 2 * N_LAYOUT, HOSTS)[view], weight, steps=steps, decay=(1e-5, 1e-4)[view])
        if view:
            self.model.meta, self.model.meta_b = w, b
        else:
            self.model.words, self.model.words_b = w, b

    def finish(self) -> CoTrained:
        model, truth = self.model, np.array([r["label"] for r in self.held], float)
        a = self._bags(0, self.held).dot(model.words) + model.words_b
        b = self._bags(1, self.held).dot(model.meta) + model.meta_b
        model.text_fit, model.meta_fit = (dense_logistic(x[::2, None], truth[::2], 0.1) for x in (a, b))
        a, b = model.text_fit[0] * a + model.text_fit[1], model.meta_fit[0] * b + model.meta_fit[1]
        model.both = dense_logistic(np.column_stack([np.clip(a, -10, 10), np.clip(b, -10, 10)])[1::2], truth[1::2], 0.1)
        balance = np.clip(truth.mean(), 0.01, 0.99)
        model.both[-1] += np.log(self.share / (1 - self.share)) - np.log(balance / (1 - balance))
        return model


def _features(made: DataFrame, wanted: DataFrame) -> list[dict]:
    """Features of the documents that ``wanted`` (doc_id, label) lists, in an order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (words, n), (shapes, _) = _cells_of(batch.column(1)), _cells_of(batch.column(2))
            row = np.repeat(np.arange(len(n)), n)
            both, count = np.unique(np.concatenate([row, row]) * WORDS + np.concatenate([words, shapes]), return_counts=True)
            ptr = pa.array(np.searchsorted(both // WORDS, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(5), pa.ListArray.from_arrays(ptr, pa.array(both % WORDS, pa.int32())), pa.ListArray.from_arrays(ptr, pa.array(count, pa.int32())), batch.column(3), batch.column(4)],
                ["doc_id", "label", "cells", "counts", "layout", "meta"],
            )

    found = (
        made.join(F.broadcast(wanted), "doc_id").select("doc_id", "words", "shapes", "layout", "meta", "label")
        .mapInArrow(run, "doc_id long, label int, cells array<int>, counts array<int>, layout array<double>, meta array<long>").toArrow().combine_chunks()
    )
    order = np.argsort(mix(np.array(found.column(0).to_pylist(), np.int64).astype(np.uint64)), kind="stable")
    columns = {c: found.column(c).combine_chunks() if isinstance(found.column(c), pa.ChunkedArray) else found.column(c) for c in found.column_names}
    return [{"label": columns["label"][int(k)].as_py(), **{c: columns[c][int(k)].values.to_numpy() for c in ("cells", "counts", "layout", "meta")}} for k in order]


def train(docs: DataFrame, labels: DataFrame) -> CoTrained:
    """Learn from ``labels`` (doc_id, quality) and from all documents without a label."""
    return _trained(features(docs), labels)


def _trained(made: DataFrame, labels: DataFrame) -> CoTrained:
    marked = settle(labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")))
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    rows = _features(made, bounded(marked, "label", LABELLED, 21))
    if len({r["label"] for k, r in enumerate(rows) if k % 4}) < 2:
        model = CoTrained()
        model.both = np.zeros(3)
        return model
    learner = Learner(rows, min(0.99, max(0.01, counts.get(1, 0) / sum(counts.values()))))
    taken = marked.select("doc_id")
    good = max(1, int(HANDED * learner.share))
    for turn in range(ROUNDS + 1):
        for view in range(2):
            learner.fit(view, 100 if turn in (0, ROUNDS) else 40)
        if turn == ROUNDS:
            return learner.finish()
        sure = settle(join_counted(_views(made, learner.model).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), taken, "doc_id", "left_anti", unique=True))
        picks = []
        for view, p in enumerate(("p_content", "p_metadata")):
            for label, most, conf in ((1, good, F.col(p)), (0, max(1, HANDED - good), 1 - F.col(p))):
                picks.append(sure.filter(conf >= SURE).orderBy(conf.desc(), F.xxhash64("doc_id")).limit(most).select("doc_id", F.lit(label + 2 * view).alias("label")))
        handed = settle(picks[0].unionByName(picks[1]).unionByName(picks[2]).unionByName(picks[3]))
        for r in _features(made, handed):
            learner.handed[1 - r["label"] // 2].append((r, float(r["label"] % 2)))
        taken = settle(taken.union(handed.select("doc_id")).distinct())


def _views(made: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, p_content, p_metadata by the views as they are."""
    shared = made.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = shared.value.content(batch), shared.value.metadata(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(a)), pa.array(sigmoid(b))], ["doc_id", "p_content", "p_metadata"])

    return made.mapInArrow(run, "doc_id long, p_content double, p_metadata double")


def score(docs: DataFrame, model: CoTrained, keep: float = KEEP) -> DataFrame:
    """doc_id, p_content, p_metadata, score and kept of every document, in one pass over the texts."""
    return _scored(_source(docs), model, keep, _made)


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """:func:`train` and :func:`score` on the same documents, whose features are made once."""
    made = features(docs)
    return _scored(made, _trained(made, labels), keep, iter)


def _scored(rows: DataFrame, model: CoTrained, keep: float, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``made`` gives the FEATURES of ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in made(batches):
            a, b, s = own.combined(own.content(batch), own.metadata(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array(s), pa.array(s >= keep)], ["doc_id", "p_content", "p_metadata", "score", "kept"])

    return rows.mapInArrow(run, "doc_id long, p_content double, p_metadata double, score double, kept boolean")
