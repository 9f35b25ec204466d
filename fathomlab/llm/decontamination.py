"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most PASSAGE tokens (lower-cased runs of letters and
digits). Passages and documents are TF-IDF vectors over FEATURES hashed tokens; document frequencies
cover all documents. A randomised SVD of the passage matrix - subspace iteration, each step one
distributed product A'(A X) over the passages - gives the latent space that indexes every passage.

Every document is searched whole, in stretches about a block of STRIDE tokens: one with fewer answer
tokens than the second check asks for is skipped, the others are projected and compared with all
passages. The space spans every passage of its block, so the product of a stretch and a passage is
exact, and what the checks ask for gives the least product of a leak: other words around a passage do
not lower it, and the candidates miss nothing that passes the checks. Each candidate is then checked
on the text itself: the longest common subsequence of its passage and the stretch must have LCS of the
passage's tokens, and ANSWER of its rarest tokens (what the item asks for or about) must be among
them. That finds passages with words replaced, dropped or inserted as well as exact copies.

Defined results: null and empty texts are clean; items without tokens match nothing; an empty
benchmark leaves all clean; items with fewer than MIN_TOKENS tokens must match whole. Rows whose
doc_id is null are searched but cannot be reported: they count as clean. A doc_id that several rows
share is contaminated if one of them is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .shared import join_counted, settle
from .sketch import cell_counts
from .textops import IS_PUNCT, Text, slices

FEATURES = 1 << 16
PASSAGE = 64
#: Tokens of a block; a stretch has BEFORE tokens before its block and AFTER from its start on.
STRIDE, BEFORE, AFTER = 48, 64, 148
OVERSAMPLE, ITERATIONS = 8, 2
LCS, ANSWER, ANSWER_TOKENS, MIN_TOKENS = 0.6, 0.6, 5, 8
#: Passages that are searched at once, about; a larger benchmark is taken in blocks. The rank of a block's
#: space is its number of passages, and each passage must keep RETAINED of its norm.
BLOCK_PASSAGES, RETAINED = 256, 0.99
#: Blocks that one pass over the documents searches.
BLOCKS_AT_ONCE = 16


def tokens(column: pa.Array):
    found = Text(pc.utf8_lower(column.cast(pa.large_string()))).segments(IS_PUNCT)
    names = found.names()
    return names, (names >> np.uint64(48)).astype(np.int64), found.ptr


def document_weights(docs: DataFrame) -> np.ndarray:
    def cells_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        _, cells, ptr = tokens(column)
        return np.repeat(np.arange(len(column)), np.diff(ptr)), cells, int((np.diff(ptr) > 0).sum())

    df, n = cell_counts(docs, cells_of, FEATURES)
    # never zero: a passage that leaked into a large share of the documents keeps its weights
    return np.maximum(np.log((n + 1) / (df + 1)) + 0.1, 0.1).astype(np.float32)


def passages(benchmark: DataFrame) -> DataFrame:
    """item_id, part, names (tokens of the passage, as 64-bit names), block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, _, ptr = tokens(batch.column(1))
            out: list[tuple] = []
            for k, item in enumerate(batch.column(0).to_pylist()):
                own = names[ptr[k] : ptr[k + 1]].view(np.int64)
                parts = -(-len(own) // PASSAGE)
                out += [(item, j, piece.tolist()) for j, piece in enumerate(np.array_split(own, parts))] if parts else []
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.list_(pa.int64())))], ["item_id", "part", "names"])

    return benchmark.select("item_id", "text").mapInArrow(run, "item_id long, part int, names array<long>")


def _vector(names: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cells, tf = np.unique((names.view(np.uint64) >> np.uint64(48)).astype(np.int64), return_counts=True)
    w = tf * idf[cells]
    norm = np.linalg.norm(w)
    return cells, (w / norm if norm else w)


def _raw(names: np.ndarray, idf: np.ndarray) -> np.ndarray:
    cells, tf = np.unique((names.view(np.uint64) >> np.uint64(48)).astype(np.int64), return_counts=True)
    return tf * idf[cells]


def latent_space(items: DataFrame, idf: np.ndarray, rank: int, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors of the passages' TF-IDF matrix: the place of each of FEATURES cells among
    those that the passages have (-1 for others), and their rows (cells x rank). The driver holds only
    matrices of at most FEATURES x (rank + OVERSAMPLE); rows of the passages stay in Spark."""
    spark = items.sparkSession
    shared_idf = spark.sparkContext.broadcast(idf)

    live = np.zeros(FEATURES, bool)
    live[[r[0] for r in items.select(F.explode(F.transform("names", lambda x: F.shiftrightunsigned(x, 48))).alias("cell")).distinct().collect()]] = True
    cells_at = np.flatnonzero(live & (idf > 0))  # cells of the passages, at most FEATURES
    place = np.full(FEATURES, -1, np.int64)
    place[cells_at] = np.arange(len(cells_at))
    if not len(cells_at):
        return place, np.zeros((0, 0), np.float32)

    def product(x: np.ndarray) -> np.ndarray:
        """A'(A x), summed over tasks, cell by cell; rows are the passages' cells."""
        right = spark.sparkContext.broadcast((place, x.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where, own = right.value
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for names in batch.column(0).to_pylist():
                    cells, w = _vector(np.array(names, np.int64), shared_idf.value)
                    cells, w = where[cells[w > 0]], w[w > 0]
                    y = w @ own[cells]
                    for c, v in zip(cells.tolist(), w):
                        total[c] = total.get(c, 0) + v * y
            keys = sorted(total)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([total[k].astype(np.float32).tobytes() for k in keys], pa.binary())], ["cell", "part"])

        def add(pdf):
            import pandas as pd

            return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "part": [sum(np.frombuffer(p, np.float32).astype(np.float64) for p in pdf["part"]).astype(np.float32).tobytes()]})

        out = np.zeros(x.shape)
        for r in items.select("names").mapInArrow(run, "cell long, part binary").groupBy("cell").applyInPandas(add, "cell long, part binary").collect():
            out[r["cell"]] = np.frombuffer(r["part"], np.float32)
        right.unpersist()
        return out

    width = rank + OVERSAMPLE
    q = np.random.default_rng(seed).standard_normal((len(cells_at), width))
    for _ in range(ITERATIONS):
        q = _orthonormal(product(q), width)
    values, vectors = np.linalg.eigh(q.T @ product(q))
    best = np.argsort(-values)[:rank]
    best = best[values[best] > 1e-9]
    return place, (q @ vectors[:, best]).astype(np.float32)


def _orthonormal(z: np.ndarray, width: int) -> np.ndarray:
    q = np.linalg.svd(z, full_matrices=False)[0]
    return np.pad(q, ((0, 0), (0, width - q.shape[1])))


def lcs_length(a: list[int], b: list[int]) -> tuple[int, set[int]]:
    """Length of the longest common subsequence (bit-parallel), and the tokens of ``a`` in ``b``."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << k)
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        m = where.get(x)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count(), where.keys() & set(b)


class Index:
    """The passages of one block in the latent space, and what the checks need."""

    def __init__(self, rows: list[tuple[int, list[int]]], place: np.ndarray, space: np.ndarray, idf: np.ndarray):
        self.ids = [r[0] for r in rows]
        self.names = [[x & (2**64 - 1) for x in r[1]] for r in rows]
        self.latent = np.zeros((len(rows), space.shape[1]), np.float32)
        self.least = np.zeros(len(rows), np.float32)
        self.rare: list[list[int]] = []
        self.answers = np.zeros(len(rows), np.int64)
        for k, (_, names) in enumerate(rows):
            own = np.array(names, np.int64)
            cells, w = _vector(own, idf)
            self.latent[k] = w @ space[place[cells]]
            if np.linalg.norm(self.latent[k]) < RETAINED:
                raise ValueError(f"item {self.ids[k]}: the latent space keeps {np.linalg.norm(self.latent[k]):.3f} of a passage's norm")
            rank = idf[(own.view(np.uint64) >> np.uint64(48)).astype(np.int64)].astype(np.float64)
            order = np.argsort(-rank, kind="stable")
            self.rare.append([self.names[k][j] for j in order[:ANSWER_TOKENS]])
            self.least[k], self.answers[k] = self._least_product(k, rank, order, np.linalg.norm(_raw(own, idf)))
        self.answer_names = np.unique(np.array([x for own in self.rare for x in own], np.uint64))
        self.vocabulary = np.unique(np.array([x for own in self.names for x in own], np.uint64))
        self.place = place.astype(np.int32)
        cells = np.flatnonzero(place >= 0)
        self.weighted = space * idf[cells][:, None]

    def _least_product(self, k: int, rank: np.ndarray, order: np.ndarray, norm: float) -> tuple[float, int]:
        """The least product of passage k (as a unit vector) with a stretch that passes both checks, less
        what rounding and RETAINED may take, and the least number of different answer tokens in it."""
        own, rare = self.names[k], self.rare[k]
        tf = Counter(own)
        energy = [tf[x] * e * e for x, e in zip(own, rank)]
        times = Counter(rare)
        asked = next(m for m in range(len(rare) + 1) if m / len(rare) >= ANSWER)
        answers = sorted(energy[j] / times[own[j]] for j in order[: len(rare)])[:asked]
        most, different = 0, 0
        for n in sorted(times.values(), reverse=True):
            if most < asked:
                most, different = most + n, different + 1
        share = LCS if len(own) >= MIN_TOKENS else 1.0
        matched = next(m for m in range(len(own) + 1) if m / len(own) >= share)
        others = sorted(0.0 if own[j] in times else energy[j] for j in order[len(rare) :])
        return 0.95 * (sum(answers) + sum(others[: max(0, matched - len(rare))])) / norm, different

    def leaked(self, k: int, near: list[int]) -> float:
        """The matched share of passage k in a stretch of tokens; 0 if a check fails."""
        own, present = self.names[k], set(near)
        answers = sum(x in present for x in self.rare[k]) / len(self.rare[k])
        if answers < ANSWER:
            return 0.0
        share = lcs_length(own, near)[0] / len(own)
        return share if share >= (LCS if len(own) >= MIN_TOKENS else 1.0) else 0.0


def _among(names: np.ndarray, cells: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Places of the names that a sorted vocabulary has."""
    marked = np.zeros(FEATURES, bool)
    marked[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    known = np.flatnonzero(np.take(marked, cells))
    place = np.minimum(np.searchsorted(vocabulary, names[known]), len(vocabulary) - 1)
    return known[vocabulary[place] == names[known]]


def window_candidates(names: np.ndarray, cells: np.ndarray, ptr: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(First token of a block, row, passage) of the stretches of some texts' tokens that may hold a
    passage."""
    size = np.diff(ptr)
    blocks = -(-size // STRIDE)
    total = int(blocks.sum())
    none = np.zeros(0, np.int64)
    if not total or not len(index.latent) or not len(index.vocabulary):
        return none, none, none
    first = np.cumsum(blocks) - blocks
    row = np.repeat(np.arange(len(size)), blocks)
    head = ptr[:-1][row] + STRIDE * (np.arange(total) - first[row])
    start = np.maximum(np.arange(total) - -(-BEFORE // STRIDE), first[row])
    stop = np.minimum(np.arange(total) - (-AFTER // STRIDE), (first + blocks)[row])  # whole blocks about the stretch
    answer = np.zeros(len(cells), np.int64)
    answer[_among(names, cells, index.answer_names)] = 1
    answer = np.concatenate([[0], np.cumsum(np.add.reduceat(answer, head))])
    keep = np.flatnonzero(answer[stop] - answer[start] >= index.answers.min())
    if not len(keep):
        return none, none, none
    need = np.zeros(total + 1, np.int64)
    np.add.at(need, start[keep], 1)
    np.add.at(need, stop[keep], -1)
    need = np.cumsum(need) > 0
    slot = np.cumsum(need) - 1
    known = _among(names, cells, index.vocabulary)
    owner = np.searchsorted(head, known, side="right") - 1
    known, owner = known[need[owner]], slot[owner[need[owner]]]
    # the j-th known token of every block at once
    turn = np.arange(len(known)) - np.searchsorted(owner, owner)
    order = np.argsort(turn, kind="stable")
    cuts = np.searchsorted(turn[order], np.arange(int(turn.max()) + 2)) if len(turn) else [0]
    sums = np.zeros((int(slot[-1]) + 2, index.weighted.shape[1]), np.float32)
    for a, b in zip(cuts, cuts[1:]):
        k = order[a:b]
        sums[owner[k]] += index.weighted[index.place[cells[known[k]]]]
    product = sums @ index.latent.T  # of each block; those of a stretch's blocks add up
    got = np.zeros((len(keep), len(index.latent)), np.float32)
    for j in range(int((stop - start).max())):
        at = start[keep] + j
        inside = np.flatnonzero(at < stop[keep])
        got[inside] += product[slot[at[inside]]]
    hit_w, hit_p = np.nonzero(got >= index.least)
    return head[keep[hit_w]], row[keep[hit_w]], hit_p


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, lcs: every benchmark item found in a document, with its matched share."""
    spark = docs.sparkSession
    idf = document_weights(docs)
    items = settle(passages(benchmark).dropDuplicates())
    blocks = max(1, -(-items.count() // BLOCK_PASSAGES))
    out = None
    for first in range(0, blocks, BLOCKS_AT_ONCE):
        indexes = []
        for k in range(first, min(first + BLOCKS_AT_ONCE, blocks)):
            block = settle(items.filter(F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)) == k))
            rows = [(r["item_id"], r["names"]) for r in block.orderBy("item_id", "part").collect()]
            if rows:
                indexes.append(Index(rows, *latent_space(block, idf, len(rows)), idf))
        if indexes:
            found = _found(docs, spark.sparkContext.broadcast(indexes))
            out = found if out is None else out.unionByName(found)
    if out is None:  # not createDataFrame, whose rows take Python workers of their own
        out = spark.range(0).select(F.col("id").alias("doc_id"), F.col("id").alias("item_id"), F.lit(0.0).alias("lcs"))
    return out


def _found(docs: DataFrame, shared) -> DataFrame:
    """The leaks of the passages of some blocks, in one pass over the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, cells, ptr = tokens(batch.column(1))
            ids = batch.column(0).to_pylist()
            found: list[tuple] = []
            for index in shared.value:
                best: dict[tuple[int, int], float] = {}
                for a, r, k in zip(*(x.tolist() for x in window_candidates(names, cells, ptr, index))):
                    if best.get((r, k), 0.0) < 1.0:
                        share = index.leaked(k, names[max(ptr[r], a - BEFORE) : min(ptr[r + 1], a + AFTER)].tolist())
                        best[r, k] = max(share, best.get((r, k), 0.0))
                found += [(ids[r], index.ids[k], v) for (r, k), v in best.items() if v]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "lcs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, lcs double")


def _contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return settle(
        leaks(docs, benchmark).filter("doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.round(F.max("lcs"), 6).alias("best_lcs"))
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, items (ids found in it) and best_lcs."""
    return join_counted(docs.select("doc_id"), _contaminated(docs, benchmark), "doc_id", "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("best_lcs", F.lit(0.0)).alias("best_lcs")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is clean, with the columns they came with."""
    return join_counted(docs, _contaminated(docs, benchmark).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
