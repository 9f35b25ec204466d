"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs of letters and digits of the lower-cased text, with five hashed features each: the
token, and its first four, five, six and seven bytes (stems of inflected words). Document labels are turned
into token labels first: in a toxic document of the training sample a token is toxic if one of its features is
LIFT times as frequent in toxic documents as in clean ones, in at least SUPPORT toxic documents (fewer where there are
few to learn from). The two-state field is then trained on those sequences by gradient steps with exact forward-backward marginals.

The training sample is bounded: TOXIC_DOCS and CLEAN_DOCS documents, of each at most SAMPLE_BYTES of text; the
bytes are counted before any text leaves Spark. The document score is calibrated on documents that the field
it was scored with has not seen: the sample is cut in two, a field of each half scores the other half.

Scoring runs forward-backward over every whole text, vectorised: two-by-two transfer products of
blocks of tokens, a pass over blocks, and a pass inside blocks. The document score is a calibrated
logistic function of its greatest marginal and of the expected number of toxic tokens, corrected to
the share of toxic documents among all training labels. Tokens whose marginal is 0.5 or more give the
offending offsets (code points, end exclusive).

Defined results: texts without tokens (nulls, empty) get the score of a text whose marginals are 0
and no offsets; without any training label of either class every score is 0. Several labels for one
doc_id count as toxic if one is; labels without document, or null, are ignored; documents with a null
doc_id are scored but not learned from. Only doc_id and text are read for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .models import bounded, dense_logistic, sigmoid
from .textops import IS_PUNCT, Text, mix, slices

CELLS = 1 << 18
#: Bytes of the heads of a token that are features beside the token itself.
HEADS = (4, 5, 6, 7)
FEATURES = 1 + len(HEADS)
TOXIC_DOCS, CLEAN_DOCS = 1500, 2200
#: Bytes of text of each class in the training sample.
SAMPLE_BYTES = 4_000_000
LIFT = 6.0
#: Toxic documents in which a toxic feature occurs at least: a share of all, between two bounds.
SUPPORT_SHARE, SUPPORT = 0.08, (3, 6)
STEPS = 25
BLOCK = 64
THRESHOLD = 0.3


def tokens(column: pa.Array):
    """Segments of the lower-cased text and their feature cells (FEATURES x tokens)."""
    lowered = pc.utf8_lower(column.cast(pa.large_string()))
    found = Text(lowered).segments(IS_PUNCT)
    parts = [found.names(), *(found.names(head=n) for n in HEADS)]
    cells = [(mix(p + np.uint64(k + 1)) & np.uint64(CELLS - 1)).astype(np.int64) + k * CELLS for k, p in enumerate(parts)]
    return found, np.stack(cells) if len(found.starts) else np.zeros((FEATURES, 0), np.int64)


def _ratios(e: np.ndarray, ptr: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Forward odds of the toxic state, token by token: start with odds m[0,1]/m[0,0] (as after a clean
    token), then r -> exp(e) (m01 + r m11) / (m00 + r m10)."""
    n = len(e)
    size = np.diff(ptr)
    blocks = -(-size // BLOCK)
    total = int(blocks.sum())
    if not total:
        return np.zeros(0)
    head = np.repeat(ptr[:-1], blocks) + BLOCK * (np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    length = np.minimum(BLOCK, np.repeat(ptr[1:], blocks) - head)
    g = np.exp(e)
    # transfer of each block: (clean, toxic) weights out for clean or toxic weight in
    p = np.zeros((total, 2, 2))
    p[:, 0, 0] = p[:, 1, 1] = 1
    order = np.argsort(-length, kind="stable")
    live_at = np.searchsorted(-length[order], -np.arange(BLOCK), side="left")
    for j in range(int(length.max())):
        k = order[: live_at[j]]
        step = g[head[k] + j]
        q = p[k]
        a = q[:, :, 0] * m[0, 0] + q[:, :, 1] * m[1, 0]
        b = (q[:, :, 0] * m[0, 1] + q[:, :, 1] * m[1, 1]) * step[:, None]
        scale = (a + b).max(axis=1)[:, None]
        q[:, :, 0], q[:, :, 1] = a / scale, b / scale
        p[k] = q
    # odds before each block: a pass over the blocks of all texts together
    before = np.zeros(total)
    first = np.cumsum(blocks) - blocks
    for j in range(int(blocks.max())):
        k = first[blocks > j + 1] + j
        if not len(k):
            break
        r, q = before[k], p[k]
        before[k + 1] = (q[:, 0, 1] + r * q[:, 1, 1]) / (q[:, 0, 0] + r * q[:, 1, 0])
    out, r = np.empty(n), before
    for j in range(int(length.max())):
        k = order[: live_at[j]]
        r[k] = g[head[k] + j] * (m[0, 1] + r[k] * m[1, 1]) / (m[0, 0] + r[k] * m[1, 0])
        out[head[k] + j] = r[k]
    return out


class Field:
    """Emission weights of the toxic state and transition scores."""

    def __init__(self, w: np.ndarray, trans: np.ndarray):
        self.w, self.trans, self.final = w, trans, np.zeros(3)

    def emission(self, cells: np.ndarray) -> np.ndarray:
        return np.clip(self.w[cells].sum(axis=0), -30, 30)

    def marginals(self, e: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(toxic) of each token; forward odds; backward odds without the token's own emission."""
        m = np.exp(self.trans)
        ahead = _ratios(e, ptr, m)
        # backward, over reversed texts: b -> (m10 + g' b' m11) / (m00 + g' b' m01)
        n = len(e)
        flip = (ptr[:-1] + ptr[1:] - 1)[np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))] - np.arange(n) if n else np.zeros(0, np.int64)
        back = _backward(e[flip], ptr, m)[flip] if n else np.zeros(0)
        odds = ahead * back
        return odds / (1 + odds), ahead, back


def _backward(e: np.ndarray, ptr: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Backward odds in reversed order: 1 at a text's last token, then from g = exp(e) of the token
    just passed. As forward odds of the transposed chain, divided by the token's own emission."""
    chain = _ratios_from(e, ptr, m.T)
    return chain


def _ratios_from(e: np.ndarray, ptr: np.ndarray, mt: np.ndarray) -> np.ndarray:
    """b_0 = 1; b_t = (mt01 + s mt11) / (mt00 + s mt10) with s = exp(e_{t-1}) b_{t-1}."""
    n = len(e)
    if not n:
        return np.zeros(0)
    # _ratios gives r_t = exp(e_t) f(r_{t-1}) from r_{-1} = 0; here s_0 = exp(e_0), so the start
    # odds must map to 1: shift the first emission accordingly
    shifted = e.copy()
    heads = ptr[:-1][np.diff(ptr) > 0]
    shifted[heads] += np.log(mt[0, 0] / mt[0, 1])
    return _ratios(shifted, ptr, mt) / np.exp(e)


def train_field(cells: np.ndarray, ptr: np.ndarray, y: np.ndarray) -> Field:
    """Adagrad ascent of the conditional likelihood of token labels ``y``."""
    field = Field(np.zeros(FEATURES * CELLS), np.array([[2.0, -2.0], [0.0, 0.0]]))
    field.w[:] = 0.0
    used, at = np.unique(cells, return_inverse=True)
    at = at.reshape(cells.shape)
    w, gw, gt = np.full(len(used), -0.3), np.full(len(used), 1e-3), np.full((2, 2), 1e-3)
    inside = np.ones(len(y), bool)
    inside[ptr[:-1][np.diff(ptr) > 0]] = False
    prev = np.flatnonzero(inside) - 1
    for _ in range(STEPS):
        e = np.clip(w[at].sum(axis=0), -30, 30)
        p, ahead, back = field.marginals(e, ptr)
        g = (y - p) / 100.0
        d = sum(np.bincount(at[k], g, minlength=len(used)) for k in range(FEATURES)) - 1e-4 * w
        gw += d * d
        w += 0.6 * d / np.sqrt(gw)
        m = np.exp(field.trans)
        here = prev + 1
        s = np.exp(e[here]) * back[here]
        joint = np.stack([m[0, 0] * np.ones(len(here)), m[0, 1] * s, ahead[prev] * m[1, 0], ahead[prev] * m[1, 1] * s])
        joint /= joint.sum(axis=0)
        a, b = y[prev] > 0.5, y[here] > 0.5
        seen = np.array([(~a & ~b).sum(), (~a & b).sum(), (a & ~b).sum(), (a & b).sum()])
        dt = ((seen - joint.sum(axis=1)) / 1000.0).reshape(2, 2) - 1e-3 * field.trans
        gt += dt * dt
        field.trans += 0.2 * dt / np.sqrt(gt)
        field.trans = np.clip(field.trans, -8, 8)
    field.w[used] = w
    return field


def summary(p: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Per text: log odds of its greatest marginal, and log of 1 + expected toxic tokens (each counted
    with its own probability once more, so that many near-zero marginals of a long text add nothing)."""
    n = len(ptr) - 1
    most, total = np.full(n, 1e-9), np.zeros(n)
    full = np.flatnonzero(np.diff(ptr) > 0)
    if len(full):
        most[full] = np.clip(np.maximum.reduceat(p, ptr[:-1][full]), 1e-9, 1 - 1e-9)
        total[full] = np.add.reduceat(p * p, ptr[:-1][full])
    return np.column_stack([np.log(most / (1 - most)) / 10, np.log1p(total)])


def token_labels(cells: np.ndarray, ptr: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Labels of tokens from labels of documents (see the module's text)."""
    row = np.repeat(np.arange(len(toxic)), np.diff(ptr))
    strong = np.zeros(FEATURES * CELLS, bool)
    support = min(max(SUPPORT[0], round(SUPPORT_SHARE * int(toxic.sum()))), SUPPORT[1])
    for k in range(FEATURES):
        pairs = np.unique(row * CELLS + (cells[k] - k * CELLS))
        r, c = pairs // CELLS, pairs % CELLS
        hit = np.bincount(c[toxic[r]], minlength=CELLS)
        miss = np.bincount(c[~toxic[r]], minlength=CELLS)
        lift = (hit / max(1, toxic.sum())) / ((miss + 0.5) / max(1, (~toxic).sum()))
        strong[k * CELLS : (k + 1) * CELLS] = (hit >= support) & (lift >= LIFT)
    return (strong[cells].any(axis=0) & toxic[row]).astype(np.float64)


def _trained(sample: list[tuple[bool, np.ndarray]]) -> Field | None:
    toxic = np.array([t for t, _ in sample], bool)
    if not toxic.any() or toxic.all():
        return None
    cells = np.concatenate([c for _, c in sample], axis=1)
    ptr = np.concatenate([[0], np.cumsum([c.shape[1] for _, c in sample])]).astype(np.int64)
    return train_field(cells, ptr, token_labels(cells, ptr, toxic))


def fit(sample: list[tuple[bool, np.ndarray]], share: float) -> Field | None:
    """``sample``: (toxic, cells FEATURES x tokens) of documents; ``share``: of toxic among all labels."""
    field = _trained(sample)
    if field is None:
        return None
    seen, truth = [], []
    for half in (0, 1):
        other = _trained(sample[half::2]) or field
        rest = sample[1 - half :: 2]
        ptr = np.concatenate([[0], np.cumsum([c.shape[1] for _, c in rest])]).astype(np.int64)
        if rest:
            seen.append(summary(other.marginals(other.emission(np.concatenate([c for _, c in rest], axis=1)), ptr)[0], ptr))
            truth += [t for t, _ in rest]
    toxic = np.array(truth, float)
    field.final = dense_logistic(np.concatenate(seen), toxic)
    field.final[-1] += np.log(share / (1 - share)) - np.log(toxic.mean() / (1 - toxic.mean()))
    return field


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    """Learn from the documents that ``labels`` (doc_id, toxic) has, a bounded sample of them."""
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic") > 0).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    picked = bounded(marked.filter("toxic"), "toxic", TOXIC_DOCS, 5).unionByName(bounded(marked.filter("NOT toxic"), "toxic", CLEAN_DOCS, 5))
    held = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sizes = held.groupBy("doc_id", "toxic").agg(F.sum(F.octet_length("text")).alias("size")).collect()  # of a bounded sample
    taken, left = [], {True: SAMPLE_BYTES, False: SAMPLE_BYTES}
    for r in sorted(sizes, key=lambda r: hash_order(r["doc_id"])):
        if r["size"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["size"]
            taken.append((r["doc_id"],))
    wanted = docs.sparkSession.createDataFrame(taken, "doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, cells = tokens(batch.column(2))
            ptr = pa.array(found.ptr, pa.int32())
            lists = [pa.ListArray.from_arrays(ptr, pa.array(c, pa.int32())) for c in cells]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "toxic", *(f"c{k}" for k in range(FEATURES))])

    columns = ", ".join(f"c{k} array<int>" for k in range(FEATURES))
    found = held.join(F.broadcast(wanted), "doc_id").select("doc_id", "toxic", "text").mapInArrow(run, f"doc_id long, toxic boolean, {columns}").toArrow()
    order = np.argsort(np.array([hash_order(x) for x in found.column(0).to_pylist()]), kind="stable")
    lists = [found.column(2 + k).combine_chunks() for k in range(FEATURES)]
    sample = [(found.column(1)[int(k)].as_py(), np.stack([x[int(k)].values.to_numpy().astype(np.int64) for x in lists])) for k in order]
    total = sum(counts.values())
    return fit(sample, min(0.999, max(0.001, counts.get(True, 0) / max(1, total))))


def hash_order(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 ^ 0x5DEECE66D) % (1 << 61)


def score(docs: DataFrame, field: Field | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and ``spans`` (array of start, end) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    out = "doc_id long, score double, predicted int, spans array<struct<start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            n = batch.num_rows
            scores, spans = np.zeros(n), [[] for _ in range(n)]
            if own is not None:
                found, cells = tokens(batch.column(1))
                p = own.marginals(own.emission(cells), found.ptr)[0]
                scores = sigmoid(summary(p, found.ptr) @ own.final[:-1] + own.final[-1])
                lead = None
                for k in np.flatnonzero(p >= 0.5):
                    row = int(np.searchsorted(found.ptr, k, side="right")) - 1
                    if lead is None:  # code points before each byte (lower-casing here keeps their number)
                        lead = np.concatenate([[0], np.cumsum((found.text.data & 0xC0) != 0x80)])
                    a, b, o = found.starts[k], found.starts[k] + found.lens[k], found.text.off[row]
                    spans[row].append({"start": int(lead[a] - lead[o]), "end": int(lead[b] - lead[o])})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "score", "predicted", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, out)
