"""Helpers shared by the training-data operators: tables, lineage cuts, Arrow text buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrade.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write `df` as Parquet under the shared checkpoint folder and go on from the copy.

    Lost executors then cost a re-read instead of a recomputation, and a value that depends
    on how rows were dealt out (a row number) is fixed for every later reader. The copies of
    an application stay until its checkpoint folder is purged. `codec` is the session's unless given.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null reads as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of `column` (one longer row is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        offsets = np.append(0, np.cumsum(sizes, dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after the other, and where each row begins; null is empty."""
    array = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(array) + 1 + array.offset)[array.offset :]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, last)[first:] if last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    raw, offsets = utf8(column)
    data = raw.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:b]


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, on unsigned arrays."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
