"""Near-duplicate groups by improved consistent weighted sampling (ICWS).

A text is the weighted set of its five-word shingles: weight = occurrences x (1 + smoothed inverse
document frequency, as a share of its greatest value), so a shingle weighs between 1 and 2. Frequencies
cover all distinct texts (copies count once); they are counted in a sketch of SKETCH hashed cells, a
fixed size at any corpus size.

Two texts are near copies if the weighted Jaccard similarity is THRESHOLD with these weights or with
occurrences alone: a large group of edited copies makes its own shingles frequent, which lowers the
first but not the second. As weights lie between 1 and 2, both kinds of pair have at least LEAST of the
weights, which is what the signatures are laid out for.

Signatures are ICWS samples (Ioffe 2010). Lighter texts take one sample of all their shingles per hash;
heavier ones deal their shingles to HASHES bins and take one sample per bin (empty bins borrow from the
next). Weights near the limit do both, so two near texts always share a kind of signature. BANDS bands
of ROWS samples make buckets; a pair shares none with probability 0.000002 at similarity 0.8 of the
weights, and 0.004 at LEAST.

Buckets never emit all their pairs. Exact copies are one node. In each bucket every node is compared
with the one whose buckets hold the most nodes (of near copies, likely the original); similar ones are
connected, and connected components are contracted. Buckets that still hold several components go through tiles (see
:mod:`.ngram_join`): blocks of nodes by weight, each two in a task, which compares parity bitmaps of nodes of
different components and gives out the pairs whose bound allows 0.8, the FIRST nearest of a node at once,
more in the next round, until none is left. So no link of two nodes that share a bucket is lost. A comparison is the exact
similarity of the two whole texts.

Defined results: a text of one to four words is one shingle; texts without words (nulls too) and
rows whose doc_id is null form their own group; rows that repeat a doc_id are copies if their texts
are equal, and are told apart by their words if not; an empty table gives an empty result; columns beside doc_id and text pass through
:func:`drop_near_duplicates` untouched and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .ngram_join import bitmaps, tiles
from .shared import join_counted, settle
from .sketch import cell_counts
from .textops import IS_SPACE, Text, mix, powers, scramble, slices, windows

SHINGLE = 5
THRESHOLD = 0.8
HASHES, BANDS, ROWS = 100, 25, 4
SKETCH = 1 << 20
#: Weights lie between 1 and 2, so a pair that is near by occurrences alone has at least LEAST of the weights.
LEAST = THRESHOLD / (THRESHOLD + 2 * (1 - THRESHOLD))
SMALL_WEIGHT, FEW_SHINGLES = 450.0, 256
#: Bits of a bitmap for each shingle, and the weight of shingles that have a bitmap of their own.
BITS, HEAVY = 4, 1.5
#: Pairs of a node with other components that a round checks, and by what the next one multiplies them.
FIRST, GROWTH = 8, 128
_SALT = np.uint64(0x8F1BBCDC5A827999)
_K = np.uint64(0xC2B2AE3D27D4EB4F)
_FIELD = np.uint64(4095)
_LOG = -np.log((np.arange(4096) + 0.5) / 4096)


def _keys(names: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The key of each text's whole word sequence; 0 without words."""
    size = np.diff(ptr)
    key = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size > 0)
    if len(full):
        place = np.arange(len(names)) - np.repeat(ptr[:-1], size)
        with np.errstate(over="ignore"):
            key[full] = mix(np.add.reduceat(names * powers(int(size.max()) + 1)[place], ptr[:-1][full]) + size[full].astype(np.uint64))
    return key


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: row (ascending), name, occurrences; and per row the number of
    words and the key of the whole word sequence."""
    text = Text(column)
    words = text.segments(IS_SPACE)
    names, ptr, size = words.names(), words.ptr, words.counts()
    starts, named = windows(names, ptr, SHINGLE)
    row = np.searchsorted(ptr, starts, side="right") - 1
    key = _keys(names, ptr)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    named, row = np.concatenate([named, key[short]]), np.concatenate([row, short])
    _, first, count = np.unique(mix(named ^ scramble(text.n)[row]), return_index=True, return_counts=True)
    order = np.argsort(row[first], kind="stable")
    first, count = first[order], count[order]
    return row[first], named[first], count, size, key


def cell(named: np.ndarray) -> np.ndarray:
    return (named >> np.uint64(44)).astype(np.int64) & (SKETCH - 1)


def document_weights(docs: DataFrame, keyed: DataFrame | None = None) -> np.ndarray:
    """Inverse document frequency of each sketch cell, over the distinct texts of ``docs`` (rows with a
    null doc_id, which are compared with nothing, do not count). ``keyed``: what :func:`text_keys` gives."""

    def cells_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        row, named, _, size, _ = shingles(column)
        return row, cell(named), int((size > 0).sum())

    docs = docs.filter(F.col("doc_id").isNotNull())
    total, n = cell_counts(docs, cells_of, SKETCH)
    keyed = text_keys(docs) if keyed is None else keyed
    copied = settle(
        keyed.filter("n_words > 0 AND doc_id IS NOT NULL").groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("extra")).filter("extra > 0")
    )

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):  # rows that share a doc_id may have other texts
            words = Text(batch.column(2)).segments(IS_SPACE)
            key = _keys(words.names(), words.ptr).view(np.int64)
            yield batch.filter(pa.array(key == np.asarray(batch.column(0))))

    again = join_counted(docs.select("doc_id", "text"), copied, "doc_id", "inner").select("node", "extra", "text")
    again = again.mapInArrow(own, "node long, extra long, text string").dropDuplicates(["node"])
    over, more = cell_counts(again, cells_of, SKETCH, "extra")
    texts = n - more
    return (1 + np.log((texts + 1) / (total - over + 1)) / np.log(texts + 2)).astype(np.float32)


def _samples(named: np.ndarray, log_weight: np.ndarray, hash_no: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Of each shingle: the ICWS value to minimise and the identity that it samples."""
    with np.errstate(over="ignore"):
        h = mix(named + (np.asarray(hash_no, np.uint64) + np.uint64(1)) * _K)
    field = lambda k: (h >> np.uint64(12 * k)) & _FIELD
    r = _LOG[field(0)] + _LOG[field(1)]
    c = _LOG[field(2)] + _LOG[field(3)]
    beta = ((h >> np.uint64(48)).astype(np.float64) + 0.5) / 65536
    t = np.floor(log_weight / r + beta)
    return np.log(c) - r * (t - beta + 1), mix(h ^ t.astype(np.int64).view(np.uint64))


def _least(value: np.ndarray, ident: np.ndarray, first: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The identity of the least value of each group of consecutive entries."""
    least = np.minimum.reduceat(value, first)
    return np.maximum.reduceat(np.where(value == least[group], ident, np.uint64(0)), first)


def signatures(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, HASHES sample identities of each, and the rows' text keys. A row of middle weight
    has both kinds of signature."""
    row, named, count, size, key = shingles(column)
    return *_signatures(row, named, count * idf[cell(named)], len(size)), key


def _signatures(row: np.ndarray, named: np.ndarray, weight: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    total = np.bincount(row, weight, minlength=n_rows)
    distinct = np.bincount(row, minlength=n_rows)
    log_weight = np.log(weight)
    rows, out = [], []
    whole = (distinct > 0) & ((total <= SMALL_WEIGHT / LEAST) | (distinct <= FEW_SHINGLES))
    pick = whole[row]
    if pick.any():
        n, lw, own = named[pick], log_weight[pick], row[pick]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        group = np.cumsum(np.concatenate([[False], own[1:] != own[:-1]]))
        out.append(np.stack([_least(*_samples(n, lw, k), first, group) for k in range(HASHES)], axis=1))
        rows.append(own[first])
    binned = total > SMALL_WEIGHT
    pick = binned[row]
    if pick.any():
        n, lw = named[pick], log_weight[pick]
        bins = ((mix(n ^ _SALT) >> np.uint64(32)) % np.uint64(HASHES)).astype(np.int64)
        order = np.argsort(row[pick] * HASHES + bins, kind="stable")
        n, lw, bins = n[order], lw[order], bins[order]
        at = row[pick][order] * HASHES + bins
        head = np.concatenate([[True], at[1:] != at[:-1]])
        first, group = np.flatnonzero(head), np.cumsum(head) - 1
        got = np.zeros((n_rows, HASHES), np.uint64)
        got.reshape(-1)[at[first]] = _least(*_samples(n, lw, bins), first, group)
        got = got[binned]
        for _ in range(HASHES):  # an empty bin takes what the next one has, marked by the step
            empty = got == 0
            if not empty.any():
                break
            after = np.roll(got, -1, axis=1)
            got = np.where(empty & (after != 0), mix(after ^ _SALT), got)
        rows.append(np.flatnonzero(binned))
        out.append(mix(got ^ _K))
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, HASHES), np.uint64)
    return np.concatenate(rows), np.concatenate(out)


def similarities(a: pa.Array, b: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts: the greater of that of TF-IDF weights and that
    of occurrences."""
    n = len(a)
    salt = scramble(n)
    parts = []
    for column in (a, b):
        row, named, count, _, _ = shingles(column)
        parts.append((mix(named ^ salt[row]), row, count.astype(np.float64), idf[cell(named)].astype(np.float64)))
    _, ia, ib = np.intersect1d(parts[0][0], parts[1][0], assume_unique=True, return_indices=True)
    least = np.minimum(parts[0][2][ia], parts[1][2][ib])
    best = np.zeros(n)
    for scale in (lambda x: x[3], lambda x: np.ones(len(x[3]))):
        total = sum(np.bincount(x[1], x[2] * scale(x), minlength=n) for x in parts)
        both = np.bincount(parts[0][1][ia], least * scale(parts[0])[ia], minlength=n)
        best = np.maximum(best, np.divide(both, total - both, out=np.zeros(n), where=total > both))
    return best


def weighted_bitmaps(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of each text its occurrences, weight and two parity bitmaps: of all shingles and of the HEAVY ones. The k-th occurrence
    of a shingle is an element of its own, so two bitmaps differ in no more bits than the texts in elements."""
    row, named, count, size, _ = shingles(column)
    each = idf[cell(named)].astype(np.float64)
    every = np.repeat(np.arange(len(row)), count)
    nth = np.arange(len(every)) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        element = mix(named[every] + nth.astype(np.uint64) * _K)
    total = np.bincount(row, count, minlength=len(size)).astype(np.int64)
    heavy = each[every] >= HEAVY
    planes = [bitmaps(row[every][keep], element[keep], BITS * total) for keep in (np.ones(len(every), bool), heavy)]
    maps = [b"".join(packed[at[k] : at[k + 1]].tobytes() for packed, at in planes) for k in range(len(size))]
    return total, np.bincount(row, count * each, minlength=len(size)), maps


def may_be_near(n_a: np.ndarray, n_b: np.ndarray, w_a: np.ndarray, w_b: np.ndarray, differ: list[np.ndarray]) -> np.ndarray:
    """Whether texts of these occurrences and weights that differ in so many shingles at least, and in so many HEAVY ones, can
    reach THRESHOLD in either measure: what they share is at most half of what the sums leave when a shingle in which they differ
    weighs 1, or HEAVY. A millionth allows for sums of floats."""
    apart = differ[0] + (HEAVY - 1) * differ[1]
    reach = lambda total, off: (total - off) * (1 + 1e-6) >= THRESHOLD * (total + off)
    return reach(n_a + n_b, differ[0]) | reach(w_a + w_b, apart)


def text_keys(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and ``node``, the key of the whole word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Text(batch.column(1)).segments(IS_SPACE)
            key = _keys(words.names(), words.ptr)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.counts(), pa.int64()), pa.array(key.view(np.int64))], ["doc_id", "n_words", "node"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, node long")


def _signed(docs: DataFrame, idf) -> DataFrame:
    """node, kind (of the signature), bands: the band keys of every text, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, got, key = signatures(batch.column(0), idf.value)
            if not len(rows):
                continue
            folded = np.zeros((len(rows), BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(ROWS):
                    folded = mix(folded * _K + got[:, k * BANDS : (k + 1) * BANDS])
                folded = mix(folded ^ scramble(BANDS)[None, :])
            kind = np.zeros(len(rows), np.int32)
            kind[1:][rows[1:] <= rows[:-1]] = 1  # rows ascend within a kind
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(folded.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(key[rows].view(np.int64)), pa.array(np.maximum.accumulate(kind)), bands], ["node", "kind", "bands"])

    return docs.select("text").mapInArrow(run, "node long, kind int, bands array<long>").dropDuplicates(["node", "kind"])


def _named(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a doc_id that ``nodes`` (doc_id, node) names, and last ``__fl_node``."""
    held = join_counted(docs.withColumnRenamed("doc_id", "__fl_doc"), nodes.select(F.col("doc_id").alias("__fl_doc"), F.col("node").alias("__fl_node")), "__fl_doc", "inner")
    return held.select(*[F.col("__fl_doc").alias("doc_id") if c == "doc_id" else F.col(c) for c in docs.columns], "__fl_node")


def _matching(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Of rows as :func:`_named` gives them, with the text in column ``at``, those whose words are the node's: rows
    that share a doc_id are told apart by their words."""
    for batch in slices(batches):
        words = Text(batch.column(at)).segments(IS_SPACE)
        yield batch.filter(pa.array(_keys(words.names(), words.ptr).view(np.int64) == np.asarray(batch.column(len(batch.columns) - 1))))


def _own(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``nodes`` (doc_id, node) names, with ``__fl_node``."""
    held, at = _named(docs, nodes), docs.columns.index("text")
    return held.mapInArrow(lambda batches: _matching(batches, at), held.schema)


def _verified(docs: DataFrame, first: DataFrame, pairs: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar. ``first``: node, doc_id of one text of it."""
    ends = settle(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(first, "node"))
    texts = _own(docs.select("doc_id", "text"), ends).select(F.col("__fl_node").alias("node"), "text").dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_b"):
            for piece in slices(iter([batch]), "text_a"):
                near = pa.array(similarities(piece.column(2), piece.column(3), idf.value) >= THRESHOLD)
                yield pa.RecordBatch.from_arrays([piece.column(0).filter(near), piece.column(1).filter(near)], ["a", "b"])

    both = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    return settle(both.mapInArrow(run, "a long, b long"))


def _mapped(docs: DataFrame, first: DataFrame, nodes: DataFrame, idf) -> DataFrame:
    """node, n, w, bits (see :func:`weighted_bitmaps`) of ``nodes``."""
    ends = settle(nodes.join(first, "node").select("node", "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(_matching(batches, 1)):
            n, w, maps = weighted_bitmaps(batch.column(1), idf.value)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n), pa.array(w), pa.array(maps, pa.binary())], ["node", "n", "w", "bits"])

    # one operator in Python: two behind each other would have two workers a task, which stay
    texts = _named(docs.select("doc_id", "text"), ends)
    return settle(texts.mapInArrow(run, "node long, n long, w double, bits binary").dropDuplicates(["node"]))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as (doc_id, n_words, node), and per node: copy_of (its least doc_id), and class_id, keeper of its
    group: the least doc_id and the node that has it."""
    spark = docs.sparkSession
    keyed = settle(text_keys(docs))
    idf = spark.sparkContext.broadcast(document_weights(docs, keyed))  # SKETCH floats
    first = settle(keyed.filter("n_words > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    signed = settle(_signed(docs.filter(F.col("doc_id").isNotNull()), idf))
    members = signed.select("node", "kind", F.posexplode("bands").alias("band", "bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = settle(members.join(sizes, "bucket"))
    fame = crowded.groupBy("node").agg(F.sum("n").alias("fame"))
    shared = settle(crowded.select("bucket", "node").join(fame, "node"))
    pivots = shared.groupBy("bucket").agg(F.max(F.struct("fame", "node"))["node"].alias("pivot"))
    tried = settle(
        shared.join(pivots, "bucket").filter("pivot <> node")
        .select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    )
    edges = _verified(docs, first, tried, idf)
    labels = components(edges)
    maps, most, further = None, FIRST, True
    while further:
        members = shared.select(F.col("bucket").alias("gid"), "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_ = members.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("who"))
        one = settle(open_.filter("low <> high AND size > 2").groupBy("size", "who").agg(F.min("gid").alias("gid")).select("gid"))  # pairs have met
        if one.isEmpty():
            break
        members = settle(members.join(one, "gid", "left_semi"))
        maps = maps or _mapped(docs, first, members.select("node").distinct(), idf)  # later rounds have a part of these nodes
        found = settle(tiles(members, maps, most, may_be_near, LEAST, 2, True))
        further = not found.filter("more").isEmpty()
        fresh = settle(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            near = _verified(docs, first, fresh, idf)
            tried = tried.union(fresh)
            if not near.isEmpty():
                edges = edges.union(near)
                labels = components(edges)
        most *= GROWTH
    groups = settle(
        first.join(labels, "node", "left")
        .select("node", F.col("doc_id").alias("copy_of"), F.coalesce("label", "node").alias("label"))
    )
    least = groups.groupBy("label").agg(F.min(F.struct("copy_of", "node")).alias("least"))
    return keyed, groups.join(least, "label").select("node", "copy_of", F.col("least.copy_of").alias("class_id"), F.col("least.node").alias("keeper"))


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, ``copy_of`` (least doc_id with the same words) and ``class_id`` (least doc_id
    of its group of near duplicates)."""
    keyed, named = _grouped(docs)
    worded = F.expr("n_words > 0 AND doc_id IS NOT NULL")
    return (
        keyed.filter(worded).select("doc_id", "node").join(named, "node").select("doc_id", "copy_of", "class_id")
        .unionByName(keyed.filter(~worded).select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id")))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the least doc_id (one of equal
    rows). Rows with a null doc_id and rows without words stay."""
    keyed, named = _grouped(docs)
    rows = settle(keyed.filter("n_words > 0 AND doc_id IS NOT NULL").join(named, "node").select("doc_id", "node", (F.expr("doc_id = class_id AND node = keeper")).alias("keeps")))
    repeated = settle(keyed.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    gone = rows.filter("NOT keeps").select("doc_id")
    if repeated.isEmpty():
        return join_counted(docs, settle(gone), "doc_id", "left_anti").select(*docs.columns)
    once = join_counted(docs, settle(gone.union(repeated).distinct()), "doc_id", "left_anti").select(*docs.columns)
    again = docs.join(repeated, "doc_id", "left_semi").select(*docs.columns)
    kept = rows.filter("keeps").join(repeated, "doc_id", "left_semi").select("doc_id", "node").distinct()
    bare = settle(keyed.filter("n_words = 0").join(repeated, "doc_id", "left_semi").select("doc_id", "node").distinct())
    return (
        once.unionByName(_own(again, kept).dropDuplicates(["doc_id", "__fl_node"]).select(*docs.columns))
        .unionByName(_own(again, bare).select(*docs.columns))
    )
