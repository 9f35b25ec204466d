"""Removal of long repeated substrings by recompression.

Words are named by 64-bit hashes, and rounds of recompression replace neighbouring names by names of
pairs (a left-class name before a right-class one; classes are bits of the name's hash in that
round) and, in later rounds, runs of one name by the name of the run. Names depend on content alone,
so every task of the cluster gives the same substring the same interior names without exchanging a
dictionary.

* After LOW_ROUNDS rounds of pairs a name covers at most 4 words and depends on at most 3 words
  beside a repeat, so two repeats of 50 words cut their interior at the same places. Each cut opens a
  phrase of PHRASE words; of the phrases that start at REACH consecutive words the one of the least
  name is an *anchor*: two equal windows of 50 words hold the same anchor at the same place.
* Later rounds make *high* names of HIGH_WORDS words or more, and one name stands for the whole text.

Spark groups names over the corpus. A high name that a smaller doc_id has too reveals and verifies
a long repeat at once: all its words go. Elsewhere only windows whose anchor occurs in several texts
are compared, by their own names, against the smallest doc_id that has them. Each word covered by a
window whose words also start in a document with a smaller doc_id is removed, exactly: what decides is
a pair of 64-bit names of the words (``sym`` or ``name``, and ``check``), of different bases.

Hot names (of a passage that a large share of the documents has) are spread over tasks where rows meet; a
window is hot if its anchor is, which equal windows agree on.

Defined results: a null text has no words; texts under 50 words lose nothing; a row whose doc_id is
null is neither a source nor loses words; rows that repeat a doc_id do not count as smaller than
each other, and each is cut by its own text; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import HOT, SALTS, join_spread, settle
from .textops import IS_SPACE, Text, mix, powers, slices, windows

WINDOW = 50
LOW_ROUNDS = 2
#: A low name covers at most LOW_SPAN words and depends on at most EDGE words beyond a repeat.
LOW_SPAN, EDGE = 4, 3
#: Words of the phrase that names a cut: so many that chance repeats are rare.
PHRASE = 8
#: Starts of phrases among which the least is an anchor.
REACH = min(WINDOW - EDGE - PHRASE, WINDOW - 2 * EDGE - LOW_SPAN) + 1
HIGH_WORDS = 128
HIGH_ROUNDS = 24
_FAR = np.uint64(2**64 - 1)
_CHECK = np.uint64(0x589965CC75374CC3)
_A, _B, _C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


class Parse:
    """Names of a slice of texts: ``sym`` with first word ``at``, ``span`` in words and ``row``."""

    def __init__(self, names: np.ndarray, ptr: np.ndarray):
        self.sym, self.at = names, np.arange(len(names))
        self.span = np.ones(len(names), np.int64)
        self.row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))

    def _keep(self, mask: np.ndarray) -> None:
        self.sym, self.at, self.span, self.row = self.sym[mask], self.at[mask], self.span[mask], self.row[mask]

    def pairs(self, round_: int, most: int) -> None:
        """Name neighbours of left and right class together, if they cover ``most`` words at most
        (or, beyond that, if neither is a finished high name)."""
        if len(self.sym) < 2:
            return
        with np.errstate(over="ignore"):
            left = (mix(self.sym + np.uint64(round_) * _C) >> np.uint64(63)) == 0
            join = left[:-1] & ~left[1:] & (self.row[:-1] == self.row[1:])
            join &= (self.span[:-1] + self.span[1:] <= most) | ((self.span[:-1] < HIGH_WORDS) & (self.span[1:] < HIGH_WORDS) & (most >= HIGH_WORDS))
            k = np.flatnonzero(join)
            self.sym = self.sym.copy()
            self.sym[k] = mix(self.sym[k] * _A + mix(self.sym[k + 1] + _B))
        self.span[k] += self.span[k + 1]
        keep = np.ones(len(self.sym), bool)
        keep[k + 1] = False
        self._keep(keep)

    def runs(self) -> None:
        """Name each run of one name, if it is not high already."""
        if len(self.sym) < 2:
            return
        same = (self.sym[1:] == self.sym[:-1]) & (self.row[1:] == self.row[:-1]) & (self.span[1:] < HIGH_WORDS)
        if not same.any():
            return
        head = np.concatenate([[True], ~same])
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(head)))
        span = np.add.reduceat(self.span, first)
        with np.errstate(over="ignore"):
            named = np.where(count > 1, mix(self.sym[first] * _B + count.astype(np.uint64) * _C), self.sym[first])
        self._keep(head)
        self.sym, self.span = named, span


def _sliding(values: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each ``size`` consecutive values."""
    pick = np.minimum if least else np.maximum
    width, out = 1, values
    while width * 2 <= size:
        out = pick(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def _phrases(names: np.ndarray, ptr: np.ndarray, parse: Parse) -> np.ndarray:
    """Per word, the name of the phrase that starts there if a low name does, else the greatest."""
    order = np.full(len(names), _FAR)
    starts, named = windows(names, ptr, PHRASE)
    cut = np.zeros(len(names), bool)
    cut[parse.at] = True
    cut = cut[starts]
    order[starts[cut]] = named[cut]
    return order


def _valid_starts(ptr: np.ndarray, n: int, size: int) -> np.ndarray:
    end = np.repeat(ptr[1:], np.diff(ptr))
    return np.arange(n) + size <= end


def low(names: np.ndarray, ptr: np.ndarray) -> Parse:
    parse = Parse(names, ptr)
    for k in range(LOW_ROUNDS):
        parse.pairs(k, LOW_SPAN)
    return parse


def anchors(order: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Words at which an anchor starts."""
    n = len(order)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    least = _sliding(order, REACH, True)  # of starts i .. i + REACH - 1
    start = _valid_starts(ptr, n, WINDOW)[: n - WINDOW + 1]  # windows of words
    least = np.where(start, least[EDGE : EDGE + len(start)], np.uint64(0))
    around = np.zeros(n + 2 * REACH, np.uint64)  # value of the window whose starts begin at i, shifted by REACH
    around[REACH + EDGE : REACH + EDGE + len(least)] = least
    best = _sliding(around, REACH, False)[1 : n + 1]  # windows that begin at p - REACH + 1 .. p
    return np.flatnonzero((best == order) & (order != _FAR))


def _second(names: np.ndarray, at: np.ndarray, span: np.ndarray) -> np.ndarray:
    """A second name of some disjoint runs of words, in ascending order."""
    if not len(at):
        return np.zeros(0, np.uint64)
    edges = np.stack([at, at + span], axis=1).reshape(-1)
    place = np.arange(len(names)) - np.take(at, np.maximum(np.searchsorted(at, np.arange(len(names)), side="right") - 1, 0))
    with np.errstate(over="ignore"):
        value = mix(names ^ _CHECK) * np.take(powers(int(span.max()) + 1), place, mode="clip")
        total = np.add.reduceat(np.append(value, np.uint64(0)), edges)[::2]
        return mix(total + span.astype(np.uint64))


def symbols(column: pa.Array) -> dict[str, np.ndarray]:
    """Anchors (span 0), high names and whole texts of a slice: name and second name (of anchors 0), row,
    first word, span, and the text's own key (for whole texts: none)."""
    text = Text(column)
    words = text.segments(IS_SPACE)
    names, ptr = words.names(), words.ptr
    size = np.diff(ptr)
    parse = low(names, ptr)
    order = _phrases(names, ptr, parse)
    at = anchors(order, ptr)
    zero = np.zeros(len(at), np.int64)
    out = [(order[at], np.searchsorted(ptr, at, side="right") - 1, at, zero, zero.view(np.uint64))]
    big = np.repeat(size >= HIGH_WORDS, size)
    if big.any():
        parse._keep(big[parse.at])
        for k in range(LOW_ROUNDS, LOW_ROUNDS + HIGH_ROUNDS):
            parse.runs()
            parse.pairs(k, HIGH_WORDS)
        high = parse.span >= HIGH_WORDS
        out.append((parse.sym[high], parse.row[high], parse.at[high], parse.span[high], _second(names, parse.at[high], parse.span[high])))
    key = np.zeros(text.n, np.uint64)
    full = np.flatnonzero(size > 0)
    if len(full):
        place = np.arange(len(names)) - np.repeat(ptr[:-1], size)
        with np.errstate(over="ignore"):
            key[full] = mix(np.add.reduceat(names * powers(int(size.max()) + 1)[place], ptr[:-1][full]) + size[full].astype(np.uint64))
    long = np.flatnonzero(size >= WINDOW)
    out.append((mix(key[long] ^ _B), long, ptr[:-1][long], size[long], _second(names, ptr[:-1][long], size[long])))
    sym, row, at, span, check = (np.concatenate([x[k] for x in out]) for k in range(5))
    whole = np.arange(len(sym)) >= len(sym) - len(long)
    return {"sym": sym.view(np.int64), "check": check.view(np.int64), "row": row, "pos": at - ptr[:-1][row] if len(row) else at, "span": span, "key": key[row].view(np.int64), "whole": whole}


def occurrences(texts: DataFrame) -> DataFrame:
    """sym, check, doc_id, own, pos, span and ``text_key``: what tells texts apart (for whole texts,
    doc_id). ``texts``: doc_id, own, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = symbols(batch.column(2))
            ids, own = (batch.column(k).to_numpy(zero_copy_only=False)[found["row"]] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found["sym"]), pa.array(found["check"]), pa.array(ids, pa.int64()), pa.array(own, pa.int64()), pa.array(found["pos"], pa.int32()), pa.array(found["span"], pa.int32()), pa.array(np.where(found["whole"], ids, found["key"]), pa.int64())],
                ["sym", "check", "doc_id", "own", "pos", "span", "text_key"],
            )

    return texts.filter(F.col("doc_id").isNotNull()).mapInArrow(run, "sym long, check long, doc_id long, own long, pos int, span int, text_key long")


def _candidate_windows(column: pa.Array, marks: list[list[dict]]) -> tuple[np.ndarray, ...]:
    """Row, first word in the row, name, second name and whether it is hot, of each window that has to be
    compared."""
    text = Text(column)
    words = text.segments(IS_SPACE)
    names, ptr = words.names(), words.ptr
    n = len(names)
    empty = np.zeros(0, np.int64)
    if n < WINDOW or not any(marks):
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64), np.zeros(0, bool)
    shared, hot = np.zeros(n, bool), np.zeros(n, bool)
    upto = np.zeros(n, np.int64)  # end of the repeated high name that covers a word
    for k, found in enumerate(marks):
        for m in found or ():
            a = ptr[k] + m["pos"]
            if m["span"]:
                upto[a : a + m["span"]] = np.maximum(upto[a : a + m["span"]], a + m["span"])
            else:
                shared[a], hot[a] = True, m["hot"]
    order = _phrases(names, ptr, low(names, ptr))
    least = _sliding(order, REACH, True)
    least_shared = _sliding(np.where(shared, order, _FAR), REACH, True)
    least_hot = _sliding(np.where(hot, order, _FAR), REACH, True)
    starts, named = windows(names, ptr, WINDOW)
    second = windows(mix(names ^ _CHECK), ptr, WINDOW)[1]
    take = (least[starts + EDGE] == least_shared[starts + EDGE]) & (least_shared[starts + EDGE] != _FAR) & (upto[starts] < starts + WINDOW)
    starts, named, second = starts[take], named[take], second[take]
    row = np.searchsorted(ptr, starts, side="right") - 1
    return row, starts - ptr[row], named, second, least_hot[starts + EDGE] == least[starts + EDGE]


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``, the words that stay, joined by single spaces."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("own"), "text")  # own: tells rows that share a doc_id apart
    found = occurrences(texts)
    several = settle(
        found.groupBy("sym", "check")
        .agg(F.min("doc_id").alias("first_doc"), F.min("text_key").alias("a"), F.max("text_key").alias("b"), F.count("*").alias("n"))
        .filter("a <> b")
        .select("sym", "check", "first_doc", "n")
    )
    total = several.agg(F.sum("n")).first()[0] or 0
    marks = settle(
        join_spread(found, several.withColumn("hot", F.col("n") >= total * HOT), ["sym", "check"], "doc_id")
        .filter("span = 0 OR first_doc < doc_id")
        .groupBy("doc_id", "own")
        .agg(F.collect_set(F.struct("pos", "span", "hot")).alias("marks"))
    )
    texts = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "own")

    def name_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, start, named, second, hot = _candidate_windows(batch.column(2), batch.column(3).to_pylist())
            ids, own = (batch.column(k).to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(named.view(np.int64)), pa.array(second.view(np.int64)), pa.array(ids, pa.int64()), pa.array(own, pa.int64()), pa.array(start, pa.int32()), pa.array(hot)], ["name", "check", "doc_id", "own", "start", "hot"])

    compared = (
        texts.join(marks, ["doc_id", "own"], "left").select("doc_id", "own", "text", "marks")
        .mapInArrow(name_windows, "name long, check long, doc_id long, own long, start int, hot boolean")
    )
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    firsts = (
        compared.groupBy("name", "check").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.max("hot").alias("hot"))
        .filter("first_doc < last_doc").select("name", "check", "first_doc", F.explode(salts).alias("salt"))
    )
    dealt = compared.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    starts = dealt.join(firsts, ["name", "check", "salt"]).filter("first_doc < doc_id").groupBy("doc_id", "own").agg(F.collect_set("start").alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, kept = [], [], []
            texts_, marks_, starts_ = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for text, spans, begin in zip(texts_, marks_, starts_):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, begin or [], 1)
                np.add.at(edge, [b + WINDOW for b in begin or []], -1)
                for m in spans or ():
                    if m["span"]:
                        edge[m["pos"]] += 1
                        edge[m["pos"] + m["span"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(compress(words, ~gone) if n_removed[-1] else words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return (
        texts.join(marks, ["doc_id", "own"], "left")
        .join(starts, ["doc_id", "own"], "left")
        .select("doc_id", "text", "marks", "starts")
        .mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
    )
