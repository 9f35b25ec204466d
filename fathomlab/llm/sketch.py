"""Document frequencies of hashed features in a sketch of fixed size."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textops import slices

PARTS = 16
FANOUT = 16


def cell_counts(docs: DataFrame, cells_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, int]], size: int, times: str | None = None) -> tuple[np.ndarray, int]:
    """In how many texts each cell occurs, and the number of texts. ``cells_of`` gives, for a string
    column, row and cell of each feature and the number of texts that count. With the column ``times``, each
    text (all of them count then) counts so many times. Tasks add up their own
    rows; sums meet in two levels, cut into PARTS, so no task and not the driver sees more than a few
    arrays of ``size`` numbers."""

    def pack(total: np.ndarray, n: int) -> list:
        raw = [zlib.compress(x.astype("<u8").tobytes(), 1) for x in total.reshape(PARTS, -1)]
        return [pa.array(range(PARTS), pa.int32()), pa.array(raw, pa.binary()), pa.array([n] * PARTS, pa.int64())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in slices(batches):
            row, cell, rows = cells_of(batch.column(0))
            found = np.unique(row * size + cell)
            if times is None:
                total += np.bincount(found % size, minlength=size)
                n += rows
            else:
                each = np.asarray(batch.column(1), np.int64)
                total += np.bincount(found % size, each[found // size], minlength=size).astype(np.int64)
                n += int(each.sum())
        if n:
            yield pa.RecordBatch.from_arrays(pack(total, n), ["part", "counts", "n"])

    def add(pdf):
        import pandas as pd

        total = sum(np.frombuffer(zlib.decompress(raw), "<u8").astype(np.int64) for raw in pdf["counts"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "counts": [zlib.compress(total.astype("<u8").tobytes(), 1)], "n": [pdf["n"].sum()]})

    schema = "part int, counts binary, n long"
    counted = docs.select("text", *([times] if times else [])).mapInArrow(count, schema).withColumn("at", (F.rand(3) * FANOUT).cast("int"))
    rows = counted.groupBy("part", "at").applyInPandas(add, schema).groupBy("part").applyInPandas(add, schema).collect()
    total, n = np.zeros(size, np.int64), 0
    for r in rows:
        total.reshape(PARTS, -1)[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), "<u8")
        n = r["n"]
    return total, n
