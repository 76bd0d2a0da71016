"""Hashed character n-grams of whole texts, computed over Arrow buffers without a Python loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrade.llm.common import bounded

BITS = 17
ORDERS = (1, 2, 3)
#: Bytes of text worked on at once.
SLICE = 1 << 19


def code_points(column: pa.Array, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each closed by a zero, and where each text begins; null is empty.

    `fold` lower-cases letters and makes every digit a nought.
    """
    column = column.cast(pa.large_string()).fill_null("")
    if fold:
        column = pc.utf8_lower(column)
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("\0".join([*column.to_pylist(), ""]).encode("utf-32-le"), np.uint32)
    if fold:
        points = np.where((points >= 48) & (points < 58), np.uint32(48), points)
    return points, np.cumsum(lengths + 1) - (lengths + 1)


def grams(points: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram at every place; past a text's end it is filled with zeros."""
    for order in orders:
        key = np.full(len(points), order, np.uint64)
        here, open_ = points.astype(np.uint64), np.ones(len(points), bool)
        for k in range(order):
            if k:
                open_ = open_ & (here != 0)
                here = np.append(points[k:], np.zeros(min(k, len(points)), np.uint32)).astype(np.uint64)
            key = key * np.uint64(0x100000001B3) + np.where(open_, here, np.uint64(0))
        key = key ^ (key >> np.uint64(29))
        yield ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def sums(points: np.ndarray, starts: np.ndarray, weights: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> np.ndarray:
    """For each text the mean of its n-grams' weights, times 100, summed over the orders."""
    lengths = np.diff(np.append(starts, len(points)))
    total = sum(np.add.reduceat(weights[h], starts, axis=0, dtype=np.float64) for h in grams(points, orders, bits))
    return 100 * total / (lengths[:, None] if total.ndim > 1 else lengths)


def features(points: np.ndarray, idf: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and their TF-IDF: the share of the text's n-grams in percent, times IDF."""
    found = np.concatenate(list(grams(points, orders, bits)))
    buckets, counts = np.unique(found, return_counts=True)
    return buckets, (100.0 * counts / len(points) * idf[buckets]).astype(np.float32)


def document_frequency(docs: DataFrame, fold: bool = True, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many of all rows of `docs` (text) each bucket occurs, and the number of rows.

    Every task sums its rows; the result has one number per bucket, whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, rows = np.zeros(1 << bits, bool), np.zeros(1 << bits, np.int64), 0
        for batch in bounded(batches, "text", SLICE):
            points, starts = code_points(batch.column("text"), fold)
            ends = np.append(starts[1:], len(points))
            found = list(grams(points, orders, bits))
            rows += len(starts)
            for a, b in zip(starts.tolist(), ends.tolist()):
                if b - a < 4000:
                    total[np.unique(np.concatenate([h[a:b] for h in found]))] += 1
                else:
                    for h in found:
                        seen[h[a:b]] = True
                    total += seen
                    seen[:] = False
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["bucket", "n"])

    counts = docs.select(docs["text"]).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out, rows = np.zeros(1 << bits), 0
    if len(counts):
        table = counts["bucket"].to_numpy(), counts["n"].to_numpy()
        rows = int(table[1][table[0] < 0].sum())
        out[table[0][table[0] >= 0]] = table[1][table[0] >= 0]
    return out, rows
