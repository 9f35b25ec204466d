"""Token ids in fixed-width bit packing.

A file holds the ids of consecutive documents. Each id takes the least number of bits that the
vocabulary needs; ids are packed in blocks of BLOCK ids that start on a byte, and a footer has the
byte offset of each block, so any range of ids is read by unpacking only its blocks, in numpy.

    header   magic b"FTOK", version u8, bits u8, 2 zero bytes
    body     blocks: ids, lowest bit first
    footer   block offsets u64[], doc ids i64[], doc id is null u8[], ids per document u64[]
    tail     number of blocks, of documents, of ids (u64 each), byte offset of the footer u64, magic

Documents are dealt by ranges of doc_id (hash of the text between equal ids), about FILE_BYTES of text a
range; a range's files end at the first document past FILE_IDS ids, so the files in order of their two
numbers hold the corpus in ascending doc_id; null doc_ids come first. The list of files, and how many ids
lie before each, stay in Spark; files are read by ranges of bytes. Repeated rows are written each. Null
texts have only the end id. An empty table gives a file without documents. Files are written to the
shared folder under a temporary name and then moved, so a task that is run again after the loss of an
executor leaves the same files.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import settle, shared_dir
from .textops import slices

MAGIC = b"FTOK"
BLOCK = 4096
#: Bytes of text of a task that writes files, about; ids after which it starts another file.
FILE_BYTES, FILE_IDS = 32 << 20, 1 << 25
#: Files whose numbers of ids are added up together.
GROUP = 4096
#: Words whose ids each Python worker keeps in each of two generations.
CACHED_WORDS = 300_000
#: White space other than single spaces and newlines between other characters: such texts are encoded whole.
_UNSAFE = r"[\t\x0B-\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
_HEADER, _TAIL = struct.Struct("<4sBBxx"), struct.Struct("<QQQQ4s")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits of each id, lowest first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    """Packs documents one after another; only a block and the footer are held."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.at = out.write(_HEADER.pack(MAGIC, 1, bits))
        self.offsets: list[int] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.rest: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, docs: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs += docs
        self.sizes += sizes.tolist()
        self.rest.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BLOCK:
            self._blocks(self.held // BLOCK * BLOCK)

    def _blocks(self, n: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        for k in range(0, n, BLOCK):
            raw = pack(ids[k : min(k + BLOCK, n)], self.bits)
            self.offsets.append(self.at)
            self.out.write(raw)
            self.at += len(raw)
        self.rest, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._blocks(self.held)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([x or 0 for x in self.docs], "<i8").tobytes())
        self.out.write(np.array([x is None for x in self.docs], "u1").tobytes())
        self.out.write(np.array(self.sizes, "<u8").tobytes())
        self.out.write(_TAIL.pack(len(self.offsets), len(self.docs), self.total, self.at, MAGIC))


class Reader:
    """Random access to the ids of one file (bytes, or an Arrow file): the footer, and then only the blocks
    that are asked for, are read."""

    def __init__(self, source):
        self.source = pa.BufferReader(source) if isinstance(source, bytes) else source
        end = self.source.size()
        magic, version, self.bits = _HEADER.unpack(self._bytes(0, _HEADER.size))
        blocks, docs, self.total, foot, last = _TAIL.unpack(self._bytes(end - _TAIL.size, end))
        if magic != MAGIC or last != MAGIC or version != 1:
            raise ValueError("not a token file")
        raw = self._bytes(foot, end - _TAIL.size)
        self.offsets = np.append(np.frombuffer(raw, "<u8", blocks), np.uint64(foot)).astype(np.int64)
        ids = np.frombuffer(raw, "<i8", docs, 8 * blocks)
        null = np.frombuffer(raw, "u1", docs, 8 * (blocks + docs))
        self.docs = pa.array(ids, pa.int64(), mask=null.astype(bool))
        self.sizes = np.frombuffer(raw, "<u8", docs, 8 * blocks + 9 * docs).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def _bytes(self, start: int, stop: int) -> bytes:
        self.source.seek(start)
        return self.source.read(stop - start)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids number start .. stop-1 of the file; only their blocks are read and unpacked."""
        stop = min(stop, self.total)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        own = self.offsets[first : last + 2] - self.offsets[first]
        raw = self._bytes(int(self.offsets[first]), int(self.offsets[last + 1]))
        found = np.concatenate([unpack(raw[own[b] : own[b + 1]], self.bits, min(BLOCK, self.total - (first + b) * BLOCK)) for b in range(last + 1 - first)])
        return found[start - first * BLOCK : stop - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(self.starts[k], self.starts[k + 1])


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each word that is kept:
    its byte-level pre-tokeniser always splits before a single space or newline between two other
    characters, so a text without other white space is encoded word by word. A word stands for itself
    after a space; with a newline before it, for itself after that newline."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        parts = ["Ab,", " cd", "\n.x1", " 2", "\nE", " f\tg"]
        self.by_word = self._library(["".join(parts)])[0] == b"".join(self._library(parts))
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        decoded = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        space, line = (self.tokenizer.encode(x, add_special_tokens=False).tokens for x in (" ", "\n"))
        self.opens = np.array([len(space) == len(line) == 1 and (x.startswith(space[0]) or x == line[0]) for x in decoded])

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word. They are encoded as one text: exactly the first token of a word opens with
        its space or is its newline."""
        own = [w if w[0] == "\n" else " " + w for w in words]
        ids = np.frombuffer(self._library(["".join(own)])[0], "<u4")
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(words) or at[0]:
            return self._library(own)
        raw, cuts = ids.tobytes(), np.append(at, len(ids)) * 4
        return [raw[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def _lookup(self, words: list[str]) -> list[bytes]:
        """Ids of some different words, from the cache or the library."""
        if len(self.words) > CACHED_WORDS:
            self.words, self.old = {}, self.words
        found = [self.words.get(w) for w in words]
        new = []
        for k, w in enumerate(words):
            if found[k] is None:
                found[k] = self.old.get(w)
                if found[k] is None:
                    new.append(k)
                elif len(w) <= 60:
                    self.words[w] = found[k]
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            for k, ids in zip(part, self._words([words[k] for k in part])):
                found[k] = ids
                if len(words[k]) <= 60:  # longer ones are rare, and large
                    self.words[words[k]] = ids
        return found

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each followed by ``end`` if given, and how many each has. A
        text is split into words in Arrow; each different word is looked up once and its ids are copied to
        its places."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(column)
        whole = pc.match_substring_regex(column, _UNSAFE) if self.by_word else pa.array(np.ones(n, bool))
        split = pc.split_pattern(pc.replace_substring(pc.if_else(whole, pa.scalar("", pa.large_string()), column), "\n", " \n"), " ")
        off = split.offsets.to_numpy().astype(np.int64)
        values = split.values.slice(off[0], off[-1] - off[0])
        off = off - off[0]
        head = np.zeros(len(values), bool)
        head[off[:-1]] = True  # a text's first unit has no space before it, and a whole text is one unit
        coded = values.filter(pa.array(~head)).dictionary_encode()
        known = self._lookup(coded.dictionary.to_pylist())
        heads = pc.if_else(whole, column, values.filter(pa.array(head))).to_pylist()
        known += self._library(heads)
        if end is not None:
            known.append(np.array([end], "<u4").tobytes())
        unit = np.empty(len(values), np.int64)
        unit[~head] = coded.indices.to_numpy(zero_copy_only=False)
        unit[head] = len(coded.dictionary) + np.arange(n)
        if end is not None:
            unit, off = np.insert(unit, off[1:], len(known) - 1), off + np.arange(n + 1)
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, start = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
        each = size[unit]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(start[unit] - upto[:-1], each) + np.arange(upto[-1])]
        return ids, np.diff(upto[off])


@lru_cache(maxsize=2)
def encoder(file: str) -> WordEncoder:
    return WordEncoder(file)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = None, folder: str | None = None) -> DataFrame:
    """Encode every whole text, add ``end_id`` to each, and write the files. Returns a settled
    table with one row per file: part, path, n_docs, n_ids."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = (
        docs.select("doc_id", "text")
        .withColumn("__fl_tie", F.xxhash64("text"))
        .repartitionByRange(max(1, -(-size // FILE_BYTES)), F.col("doc_id").asc_nulls_first(), "__fl_tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__fl_tie")
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        own, task = encoder(tokenizer), TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, rows, pieces = task.partitionId(), [], slices(batches, most=4 << 20)
        piece = next(pieces, None)
        while piece is not None or not rows:
            name = f"part-{part:07d}-{len(rows):05d}.ftok"
            draft = f"{root}/.draft-{name}-{task.taskAttemptId()}"
            with store.open_output_stream(draft) as out:
                writer = Writer(out, own.bits)
                while piece is not None and writer.total < FILE_IDS:
                    ids, sizes = own.encode(piece.column(1), end_id)
                    writer.add(piece.column(0).to_pylist(), sizes, ids)
                    piece = next(pieces, None)
                writer.close()
            store.move(draft, f"{root}/{name}")
            rows.append((part, len(rows), f"{folder}/{name}", len(writer.docs), writer.total))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(5)], ["part", "piece", "path", "n_docs", "n_ids"])

    return settle(ordered.mapInArrow(run, "part long, piece long, path string, n_docs long, n_ids long"))


def read_token_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, ``start`` (ids of all documents before it), n_tokens and
    ``ids_le``, its ids as little-endian unsigned 32-bit integers. ``files`` is what
    :func:`write_token_files` returned; the driver sees one number for GROUP of its parts."""
    grouped = files.withColumn("group", F.floor(F.col("part") / GROUP))
    before, bases = 0, []
    for r in grouped.groupBy("group").agg(F.sum("n_ids").alias("n")).orderBy("group").collect():
        bases.append((r["group"], before))
        before += r["n"]
    ahead = Window.partitionBy("group").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        grouped.withColumn("inside", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)))
        .join(F.broadcast(spark.createDataFrame(bases, "group long, base long")), "group")
        .select("part", "piece", "path", (F.col("base") + F.col("inside")).alias("base"))
        .repartition(max(1, files.rdd.getNumPartitions()), "part", "piece")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, base in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    file = Reader(source)
                    for k in range(0, len(file.docs), 512):
                        top = min(k + 512, len(file.docs))
                        bounds = file.starts[k : top + 1]
                        body = file.ids(bounds[0], bounds[-1]).astype("<u4").tobytes()
                        cuts = (bounds - bounds[0]) * 4
                        yield pa.RecordBatch.from_arrays(
                            [file.docs.slice(k, top - k), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array([body[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids_le"],
                        )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_le binary")


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
