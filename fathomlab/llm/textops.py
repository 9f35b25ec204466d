"""Vectorised views of Arrow text columns: words, lines and their 64-bit names, without a Python
object per word. Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once (a longer text is handled whole, by itself).
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_NAMES = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 & ~0x7 | 0x5)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Token class for lexical models: letters, digits and all bytes of non-ASCII characters.
IS_PUNCT = np.ones(256, bool)
IS_PUNCT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 2 * len(_powers)), _BASE)]))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit names."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def scramble(n: int) -> np.ndarray:
    """Names of the integers 0 .. n-1."""
    return mix(np.arange(1, n + 1, dtype=np.uint64))


class Text:
    """Rows of a string column as bytes: ``data`` and row offsets ``off`` (nulls are empty)."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        raw = column.buffers()[2] if n else None
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        if column.null_count:  # a null's slot may hold bytes
            valid = np.asarray(column.is_valid())
            if np.any(np.diff(offsets)[~valid]):
                column = column.fill_null("")
                offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
                data = np.frombuffer(column.buffers()[2], np.uint8)
        self.n, self.off, self.data = n, offsets - offsets[0], data[offsets[0] : offsets[-1]]

    def segments(self, separator: np.ndarray) -> "Segments":
        return Segments(self, separator)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Per row, how many of its bytes are marked."""
        total = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]


class Segments:
    """Maximal runs of bytes that are not separators, none crossing a row: byte ``starts`` and
    ``lens``, and ``ptr``, the first segment of each row (n + 1 entries)."""

    def __init__(self, text: Text, separator: np.ndarray):
        data, off = text.data, text.off
        sep = separator[data]
        first, last = np.empty(len(data), bool), np.empty(len(data), bool)
        if len(data):
            first[0], last[-1] = True, True
            first[1:], last[:-1] = sep[:-1], sep[1:]
            first[off[:-1][off[:-1] < len(data)]] = True
            last[off[1:][off[1:] > 0] - 1] = True
        first &= ~sep
        last &= ~sep
        self.text, self.sep, self.first = text, sep, first
        self.table = np.where(separator, np.uint64(0), _BYTE_NAMES)
        self.starts = np.flatnonzero(first)
        self.lens = np.flatnonzero(last) + 1 - self.starts
        self.ptr = np.searchsorted(self.starts, off)

    def names(self, head: int | None = None, tail: int | None = None) -> np.ndarray:
        """A 64-bit name of each segment's bytes, equal for equal bytes; of the first ``head`` or
        the last ``tail`` bytes if given."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        at = np.cumsum(self.first, dtype=np.int64)  # 0 before the first segment
        place = np.arange(len(self.sep))
        place -= np.take(np.concatenate([[0], self.starts]), at)
        value = np.take(self.table, self.text.data)  # 0 for separators
        if head is not None:
            value[place >= head] = 0
        if tail is not None:
            place -= np.take(np.concatenate([[0], np.maximum(self.lens - tail, 0)]), at)
            value[place < 0] = 0
        with np.errstate(over="ignore"):
            value *= np.take(powers(int(self.lens.max()) + 1), place, mode="clip")
            return mix(np.add.reduceat(value, self.starts))

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def rows(self) -> np.ndarray:
        """The row of each segment."""
        return np.repeat(np.arange(self.text.n), self.counts())


def windows(names: np.ndarray, ptr: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``size`` consecutive names inside a row, and the runs' names."""
    n = len(names)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total += names[k : n - size + 1 + k] * powers(size + 1)[k]
    end = np.repeat(ptr[1:], np.diff(ptr))[: n - size + 1]
    starts = np.flatnonzero(np.arange(n - size + 1) + size <= end)
    return starts, mix(total[starts])


def prefix(per_item: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(per_item)])


def per_row(per_item: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = prefix(per_item)
    return total[ptr[1:]] - total[ptr[:-1]]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
