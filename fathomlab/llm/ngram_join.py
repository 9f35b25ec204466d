"""Jaccard join of texts on distinct three-word shingles: links of at least 90 % and their components.

Words are runs outside white space, A-Z lowered. Texts with equal sets are one node. Links are found in
tiles: groups of nodes that share a rare shingle and are close in size, cut into blocks.

* **Which nodes meet.** Shingles have a global order, rare ones first (by a count in a sketch of fixed
  size; any order is right, a rare one is fast). Two sets of s and more elements that link share one of
  their first ``s // 10 + 1`` shingles in that order, so these alone are dealt out. Under one shingle, nodes are
  sorted by size and split where the next size is more than 10/9 of the last: a band.
* **Bitmaps.** Each node has the parities of how many of its shingles fall on each bit, about a bit a
  shingle. Bits in which two bitmaps differ are at most the elements in which the sets differ, which
  bounds the overlap from above. A longer bitmap folds to the length of a shorter one.
* **Exact check.** What passes is intersected as sorted arrays of shingles.

A group never emits all its pairs. First each node of a group meets one pivot, the node with most
shared shingles; what links is contracted to components. Then groups that still hold several components
go through tiles: sorted by size, cut into blocks of BLOCK nodes, and every two blocks whose sizes can link meet in a task,
which compares bitmaps of nodes of different components. Of each node the FIRST nearest are checked at once;
components are joined, and where a node had more, the next round hands out GROWTH times as many,
until no pair of different components is left that passes its bound unchecked. So all links count, and none is
lost; inside a component, pairs are not looked at as they change nothing.

Names of shingles and of sets are 64-bit hashes, as elsewhere in this subpackage.

Defined results: texts with one or two words have the whole sequence as their shingle; texts without words
(nulls too) have none and link with nothing; rows with a null doc_id link with nothing and have a null
component; rows that share a doc_id are nodes by their own texts; an empty table gives an empty
result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .shared import join_counted, join_spread, settle, spill
from .sketch import cell_counts
from .textops import IS_SPACE, Text, mix, scramble, slices, windows

SHINGLE = 3
#: Two sets link if SHARE times the size of their intersection is at least LIMIT times that of their union.
SHARE, LIMIT = 100, 90
SKETCH = 1 << 20
LEAST_BITS, MOST_BITS = 64, 1 << 15
BLOCK = 1024
#: Nodes of a tile that are compared with the others at once.
AT_ONCE = 64
#: Pairs of a node with other components that a round checks, and by what the next one multiplies them.
FIRST, GROWTH = 4, 8
#: Pairs with one node that are checked in one task.
PAIRS = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SHORT = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: row and name, sorted by both, and the number of shingles a row."""
    text = Text(column)
    text.data = _LOWER[text.data]
    words = text.segments(IS_SPACE)
    names, ptr, size = words.names(), words.ptr, words.counts()
    starts, named = windows(names, ptr, SHINGLE)
    row = np.searchsorted(ptr, starts, side="right") - 1
    one, two = np.flatnonzero(size == 1), np.flatnonzero(size == 2)
    with np.errstate(over="ignore"):
        pair = mix(mix(names[ptr[two]] * _SHORT) + names[ptr[two] + 1])
    named = np.concatenate([named, mix(names[ptr[one]] ^ _SHORT), pair])
    row = np.concatenate([row, one, two])
    order = np.lexsort((named, row))
    row, named = row[order], named[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (named[1:] != named[:-1])
    row, named = row[new], named[new]
    return row, named, np.bincount(row, minlength=text.n)


def _cell(named: np.ndarray) -> np.ndarray:
    return (named >> np.uint64(44)).astype(np.int64) & (SKETCH - 1)


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """In how many texts each cell of the sketch occurs."""

    def cells_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        row, named, size = shingle_sets(column)
        return row, _cell(named), int((size > 0).sum())

    return cell_counts(docs, cells_of, SKETCH)[0]


def bitmaps(row: np.ndarray, named: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of all rows, one behind the other, and where each begins (in bytes, one more than rows)."""
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    off = np.concatenate([[0], np.cumsum(bits)])
    odd = np.bincount(off[row] + (named & (bits[row] - 1).astype(np.uint64)).astype(np.int64), minlength=off[-1]) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little"), off // 8


def _signed(docs: DataFrame, seen) -> DataFrame:
    """doc_id, n, node, bits, firsts (the rare shingles by which a node is found) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, named, size = shingle_sets(batch.column(1))
            first = np.concatenate([[0], np.cumsum(size)])
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(named ^ _SHORT))])
                node = mix(sums[first[1:]] - sums[first[:-1]] + size.astype(np.uint64))
            node[size == 0] = 0
            packed, at = bitmaps(row, named, size)
            by_rarity = np.lexsort((named, seen.value[_cell(named)], row))
            wanted = np.where(size > 0, size - -(-LIMIT * size // SHARE) + 1, 0)
            place = np.arange(len(row)) - first[row]
            firsts = named[by_rarity][place < wanted[row]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(size, pa.int64()), pa.array(node.view(np.int64)),
                    pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(packed)]),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(wanted)]), pa.int32()), pa.array(firsts.view(np.int64))),
                ],
                ["doc_id", "n", "node", "bits", "firsts"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, node long, bits binary, firsts array<long>")


def _groups(nodes: DataFrame) -> DataFrame:
    """node, n, gid, fame: for each rare shingle and band of sizes with several nodes its members, one of the groups with
    the same members; ``fame`` is in how many groups a node was before."""
    each = nodes.select("node", "n", F.explode("firsts").alias("shingle"))
    by_size = Window.partitionBy("shingle").orderBy("n", "node")
    begins = F.coalesce(F.lag("n").over(by_size) * SHARE < F.col("n") * LIMIT, F.lit(True)).cast("int")
    banded = each.withColumn("begins", begins).withColumn("band", F.sum("begins").over(by_size)).drop("begins")
    group = Window.partitionBy("shingle", "band")
    several = (
        banded.withColumn("members", F.count("*").over(group)).withColumn("who", F.bit_xor(F.xxhash64("node")).over(group)).filter("members > 1")
        .select("node", "n", F.xxhash64("shingle", "band").alias("gid"), "members", "who")
    )
    several = settle(several)
    fame = several.groupBy("node").agg(F.count("*").alias("fame"))
    one = several.groupBy("members", "who").agg(F.min("gid").alias("gid")).select("gid")
    return settle(several.join(one, "gid", "left_semi").select("node", "n", "gid").join(fame, "node"))


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of bits in which each bitmap (row of 64-bit words) of ``a`` differs from each of ``b``."""
    out = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


#: Sizes of two sets, their weights, and for each plane of their bitmaps a least number of elements in which they differ, to
#: whether they can link.
Bound = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]], np.ndarray]


def _may(n_a: np.ndarray, n_b: np.ndarray, w_a: np.ndarray, w_b: np.ndarray, differ: list[np.ndarray]) -> np.ndarray:
    return may_link(n_a, n_b, differ[0])


def _words(maps: list[bytes], words: int, planes: int = 1) -> np.ndarray:
    """The bitmaps, each of ``planes`` one behind the other, folded to ``words`` 64-bit words a plane: plane, bitmap, word."""
    out = np.zeros((planes, len(maps), words), np.uint64)
    for k, raw in enumerate(maps):
        own = np.frombuffer(raw, "<u8").reshape(planes, -1, words)
        out[:, k] = np.bitwise_xor.reduce(own, axis=1)
    return out


def may_link(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes that differ in so many elements at least can link: the overlap is at most
    (n_a + n_b - differ) / 2, the union at least (n_a + n_b + differ) / 2."""
    differ = np.maximum(differ, np.abs(n_a - n_b))
    return SHARE * (n_a + n_b - differ) >= LIMIT * (n_a + n_b + differ)


def _arrays(docs: DataFrame, first: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, names: the sorted shingles of each of ``nodes``. ``first``: node, doc_id of one text of it."""
    ends = settle(nodes.join(first, "node").select("node", "doc_id"))
    held = join_counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ends, "doc_id", "inner").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, named, size = shingle_sets(batch.column(1))
            at = np.concatenate([[0], np.cumsum(size)])
            with np.errstate(over="ignore"):  # rows that share a doc_id may have other texts
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(named ^ _SHORT))])
                node = mix(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64)).view(np.int64)
            names = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(named)])
            out = pa.RecordBatch.from_arrays([batch.column(0), names], ["node", "names"])
            yield out.filter(pa.array(node == np.asarray(batch.column(0))))

    return held.mapInArrow(run, "node long, names binary").dropDuplicates(["node"])


def _linked(docs: DataFrame, first: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link, by exact intersection. Pairs of a node that has many are dealt to several
    tasks, PAIRS to each."""
    arrays = spill(_arrays(docs, first, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), "shingles")
    parts = settle(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts")))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    left = arrays.withColumnRenamed("node", "a").join(parts, "a").select("a", F.col("names").alias("names_a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = dealt.join(arrays.select(F.col("node").alias("b"), F.col("names").alias("names_b")), "b").join(left, ["a", "part"]).select("a", "b", "names_a", "names_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt, sides = scramble(batch.num_rows), []
            for column in (batch.column(2), batch.column(3)):
                size = np.array([len(x) // 8 for x in column.to_pylist()], np.int64)
                named = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
                row = np.repeat(np.arange(len(size)), size)
                sides.append((mix(named ^ salt[row]), row, size))
            _, at, _ = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
            common = np.bincount(sides[0][1][at], minlength=batch.num_rows)
            links = pa.array(SHARE * common >= LIMIT * (sides[0][2] + sides[1][2] - common))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(links), batch.column(1).filter(links)], ["a", "b"])

    return settle(both.mapInArrow(run, "a long, b long"))


def _passing(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (a, b) that the bound of their bitmaps lets pass. ``maps``: node, n, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = np.zeros(batch.num_rows, np.int64)
            for k, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                words = min(len(x), len(y)) // 8
                x, y = (np.bitwise_xor.reduce(np.frombuffer(z, "<u8").reshape(-1, words), axis=0) for z in (x, y))
                differ[k] = np.bitwise_count(x ^ y).sum()
            ok = pa.array(may_link(np.asarray(batch.column(2)), np.asarray(batch.column(3)), differ))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    side = lambda s: maps.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return both.mapInArrow(run, "a long, b long")


def _tile(label: np.ndarray, n: np.ndarray, w: np.ndarray, node: np.ndarray, maps: list[bytes], left: np.ndarray, right: np.ndarray, most: int, may: Bound, planes: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of rows ``left`` and ``right`` of a tile that are of different components and pass the bound: of each
    row the ``most`` nearest, and whether there are more."""
    maps = _words(maps, min(map(len, maps)) // 8 // planes, planes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    more = False
    sides = [(left, right), (right, left)] if left is not right else [(left, right)]
    for mine, theirs in ((mine[k : k + AT_ONCE], theirs) for mine, theirs in sides for k in range(0, len(mine), AT_ONCE)):
        differ = [_differ(plane[mine], plane[theirs]) for plane in maps]
        ok = (label[mine][:, None] != label[theirs][None, :]) & may(n[mine][:, None], n[theirs][None, :], w[mine][:, None], w[theirs][None, :], differ)
        x, y = np.nonzero(ok)
        if not len(x):
            continue
        order = np.lexsort((node[theirs][y], differ[0][x, y], x))
        x, y = x[order], y[order]
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        rank = np.arange(len(x)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        more |= bool((rank >= most).any())
        found.append((mine[x[rank < most]], theirs[y[rank < most]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    a, b = (node[np.concatenate(z)] for z in zip(*found))
    return np.minimum(a, b), np.maximum(a, b), more


def tiles(members: DataFrame, maps: DataFrame, most: int, may: Bound = _may, ratio: float = LIMIT / SHARE, planes: int = 1, several: bool = False) -> DataFrame:
    """a, b, more: pairs to check of groups with several components, by tiles. ``members``: gid, node, label; ``maps``: node, n
    (the size), w (the weight), bits (of ``planes`` bitmaps). ``may`` is the bound; sizes of less than ``ratio`` to each other
    never link. ``several``: each group is known to have several components."""
    held = members.select("gid", "node", "label")
    if not several:
        sizes = members.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("gid")
        held = held.join(sizes, "gid", "left_semi")
    held = held.join(maps.select("node", "n"), "node")
    blocks = held.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("gid").orderBy("n", "node")) - 1) / BLOCK)).drop("n")
    blocks = settle(blocks.join(maps.select("node", "n", "w", "bits"), "node"))
    spans = blocks.groupBy("gid", "block").agg(F.min("n").alias("least"), F.max("n").alias("greatest"))
    later = spans.select("gid", F.col("block").alias("other"), F.col("least").alias("next"))
    pairs = settle(spans.join(later, "gid").filter((F.col("block") <= F.col("other")) & ((F.col("block") == F.col("other")) | (F.col("greatest") >= ratio * F.col("next")))).select("gid", "block", "other"))
    side = lambda own, at: pairs.join(blocks.withColumnRenamed("block", own), ["gid", own]).withColumn("right", F.lit(at))
    dealt = side("block", False).unionByName(side("other", True).filter("block <> other"))
    dealt = dealt.select("gid", "block", "other", "right", "label", "n", "w", "node", "bits").repartition("gid", "block", "other").sortWithinPartitions("gid", "block", "other", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        sent: set[tuple[int, int, bool]] = set()

        def out(table: pa.Table) -> pa.RecordBatch | None:
            gid, block, other = (np.asarray(table.column(k)) for k in range(3))
            cut = np.flatnonzero((gid[1:] != gid[:-1]) | (block[1:] != block[:-1]) | (other[1:] != other[:-1])) + 1
            right, (label, n, w, node) = np.asarray(table.column(3)), (np.asarray(table.column(k)) for k in (4, 5, 6, 7))
            maps, got = table.column(8).to_pylist(), []
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(gid)]):
                every = np.arange(e - s)
                r = right[s:e]
                left, second = (every[~r], every[r]) if r.any() else (every, every)
                if left is not second and not (len(left) and len(second)):
                    continue
                a, b, more = _tile(label[s:e], n[s:e], w[s:e], node[s:e], maps[s:e], left, left if left is second else second, most, may, planes)
                got += [p for p in zip(a.tolist(), b.tolist(), [more] * len(a)) if p not in sent]
            got = list(dict.fromkeys(got))
            if len(sent) < 100_000:  # the same pair comes up under many shingles
                sent.update(got)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "more"]) if got else None

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            gid, block, other = (np.asarray(table.column(k)) for k in range(3))
            last = np.flatnonzero((gid != gid[-1]) | (block != block[-1]) | (other != other[-1]))
            end = int(last[-1]) + 1 if len(last) else 0  # the tile that is not complete waits
            held = table.slice(end).to_batches()
            if end and (done := out(table.slice(0, end))) is not None:
                yield done
        if held and (done := out(pa.Table.from_batches(held))) is not None:
            yield done

    return dealt.mapInArrow(run, "a long, b long, more boolean")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    seen = spark.sparkContext.broadcast(shingle_counts(docs).astype(np.uint32))  # SKETCH numbers
    signed = spill(_signed(docs, seen), "signed")
    worded = F.expr("n > 0 AND doc_id IS NOT NULL")
    rows = signed.select("doc_id", "n", "node")
    first = settle(rows.filter(worded).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")))
    nodes = spill(signed.filter(worded).drop("doc_id").dropDuplicates(["node"]), "nodes")
    groups = _groups(nodes)
    maps = nodes.select("node", "n", F.col("n").alias("w"), "bits")

    pivots = groups.groupBy("gid").agg(F.max(F.struct("fame", "node"))["node"].alias("pivot"))
    tried = settle(
        groups.join(pivots, "gid").filter("pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    )
    edges = _linked(docs, first, settle(_passing(tried, maps)))
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    labels, most, further = components(edges), FIRST, True
    while further:
        members = groups.select("gid", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        found = settle(tiles(members, maps, most))
        further = not found.filter("more").isEmpty()
        fresh = settle(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            links = _linked(docs, first, fresh)
            tried = tried.union(fresh)
            if not links.isEmpty():
                edges = edges.union(links)
                labels = components(edges)
        most *= GROWTH
    named = first.join(labels, "node", "left").select("node", "doc_id", "rows", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = settle(named.join(least, "label").select("node", "component_id", F.col("rows").alias("n")))
    held = rows.filter(worded).withColumnRenamed("n", "n_shingles")
    return (
        join_spread(held, named, ["node"], "doc_id").select("doc_id", "n_shingles", "component_id")
        .unionByName(rows.filter(~worded).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    )
