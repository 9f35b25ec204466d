"""Language identification: averaged hashed subword embeddings under a linear softmax.

Every letter of a lower-cased text gives the hashed byte 3-gram and 4-gram around it (space stands
for text ends and any white space). A text is the average of their embeddings; a linear softmax on
top is trained with stochastic gradient descent in numpy, on at most PER_LANGUAGE texts of each
language. A held-back fifth of that sample sets the softmax temperature and the score below which a
prediction counts as rejected (at least ACCURACY of the accepted ones being right there).

As the softmax is linear, embeddings and weights are multiplied once; scoring a text of any length
sums table rows, whole texts, one pass, no shuffle.

Defined results: null texts and texts without a letter get language ``und``, score 0 and rejected;
so does every text when there is nothing to learn from. Rows whose doc_id is null are not learned
from and have held_out null. Only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .models import bounded
from .textops import IS_PUNCT, IS_SPACE, Text, slices

BUCKETS = 1 << 16
DIM = 16
PER_LANGUAGE = 600
EPOCHS = 5
ACCURACY = 0.99
UNKNOWN = "und"

_LETTER = ~IS_PUNCT
_LETTER[0x30:0x3A] = False
_ASCII_LETTER = _LETTER & (np.arange(256) < 0x80)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each letter byte (ascending), and its two n-gram cells."""
    text = Text(pc.utf8_lower(column.cast(pa.large_string())))
    data, off = text.data, text.off
    b = np.where(IS_SPACE[data], np.uint8(32), data).astype(np.uint32)
    n = len(b)
    before, after, then = np.full(n, 32, np.uint32), np.full(n, 32, np.uint32), np.full(n, 32, np.uint32)
    before[1:], after[:-1], then[:-2] = b[:-1], b[1:], b[2:]
    size = np.diff(off)
    before[off[:-1][size > 0]] = 32
    after[off[1:][size > 0] - 1] = 32
    then[off[1:][size > 0] - 1] = 32
    then[off[1:][size > 1] - 2] = 32
    at = np.flatnonzero(_LETTER[data])
    three = (before[at] << np.uint32(16)) | (b[at] << np.uint32(8)) | after[at]
    four = (three << np.uint32(8)) | then[at]
    with np.errstate(over="ignore"):
        cells = [((x ^ (x >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64) for x in (three, four ^ np.uint32(0x5BD1E995))]
    return np.searchsorted(off, at, side="right") - 1, cells[0], cells[1]


def has_letter(column: pa.Array) -> np.ndarray:
    text = Text(column)
    found = text.sums(_ASCII_LETTER[text.data]) > 0
    for k in np.flatnonzero(~found & (text.sums(text.data >= 0x80) > 0)):
        found[k] = any(map(str.isalpha, column[int(k)].as_py()))
    return found


class LanguageModel:
    """Fitted tables: ``table`` (cells x languages), bias, temperature, rejection score."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, accept: float = 0.0):
        self.languages, self.table, self.bias, self.temperature, self.accept = languages, table, bias, temperature, accept

    def logits(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        row, three, four = grams(column)
        letters = np.maximum(np.bincount(row, minlength=n), 1)
        out = np.empty((n, len(self.languages)))
        for k in range(len(self.languages)):
            own = self.table[k]
            out[:, k] = np.bincount(row, own[three] + own[four], minlength=n) / (2 * letters) + self.bias[k]
        return out

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, list[int], list[int]]], seed: int = 1) -> LanguageModel | None:
    """Train on (language, cells, counts) of a bounded sample."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    rows = [rows[k] for k in rng.permutation(len(rows))]
    y = np.array([languages.index(r[0]) for r in rows])
    data = [(np.array(i), np.array(c, np.float64) / sum(c)) for _, i, c in rows]
    held = np.arange(len(rows)) % 5 == 0 if len(rows) >= 50 else np.zeros(len(rows), bool)
    train = np.flatnonzero(~held)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    w, b = rng.normal(0, 0.1, (len(languages), DIM)), np.zeros(len(languages))
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(train):
            rate = 2.0 * (1 - done / steps) + 0.01
            done += 1
            idx, share = data[k]
            h = share @ emb[idx]
            z = w @ h + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = p @ w
            w -= rate * np.outer(p, h)
            b -= 0.1 * rate * p
            emb[idx] -= rate * 20 * share[:, None] * back[None, :]
    model = LanguageModel(languages, np.ascontiguousarray((w @ emb.T)), b)
    check = np.flatnonzero(held) if held.any() else train
    z = np.stack([w @ (data[k][1] @ emb[data[k][0]]) + b for k in check])
    best = None
    for t in np.geomspace(0.05, 5, 40):
        model.temperature = t
        p = model.scores(z)
        loss = -np.log(p[np.arange(len(check)), y[check]] + 1e-12).mean()
        if best is None or loss < best[0]:
            best = (loss, t)
    model.temperature = best[1]
    p = model.scores(z)
    right, top = p.argmax(1) == y[check], p.max(1)
    order = np.argsort(-top)
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= ACCURACY)
    model.accept = float(top[order[good[-1]]]) if len(good) else 1.0
    return model


def train(rows: DataFrame) -> LanguageModel | None:
    """Learn from doc_id, text and lang of ``rows`` (a bounded sample of each language)."""
    known = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, three, four = grams(batch.column(0))
            both, count = np.unique(np.concatenate([row, row]) * BUCKETS + np.concatenate([three, four]), return_counts=True)
            ptr = pa.array(np.searchsorted(both // BUCKETS, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(ptr, pa.array(both % BUCKETS, pa.int32())), pa.ListArray.from_arrays(ptr, pa.array(count, pa.int32()))], ["lang", "cells", "counts"])

    sample = bounded(known, "lang", PER_LANGUAGE, 11).select("text", "lang").mapInArrow(run, "lang string, cells array<int>, counts array<int>")
    found = sample.toArrow()
    return fit(sorted(zip(*(found.column(k).to_pylist() for k in range(3)))))


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            column, n = batch.column(1), batch.num_rows
            known = has_letter(column) if own else np.zeros(n, bool)
            p = own.scores(own.logits(column)) if own else np.zeros((n, 1))
            top = np.where(known, p.max(1), 0.0)
            names = [own.languages[k] if ok else UNKNOWN for k, ok in zip(p.argmax(1), known)]
            rejected = ~known | (top < (own.accept if own else 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(top), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify_languages(docs: DataFrame, learn_from: DataFrame) -> DataFrame:
    return predict(docs, train(learn_from))
