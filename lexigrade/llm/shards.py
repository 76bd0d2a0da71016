"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number from (key, shard); the largest weighted draw wins. A new shard
can only win rows for itself, so growing moves the rows it takes and no other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrade.llm.common import cut, mix64

SHARDS = 16


def winners(keys: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    """Shard of each 64-bit key: the arg max of w / -ln(u) with u drawn from (key, shard)."""
    best = np.full(len(keys), -1.0)
    shard = np.zeros(len(keys), np.int32)
    for s, weight in enumerate(weights):
        draw = mix64(keys ^ mix64(np.array([s], np.uint64))[0])
        u = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        value = weight / -np.log(u)
        better = value > best
        best[better] = value[better]
        shard[better] = s
    return shard


def rendezvous(records: DataFrame, key: Column, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """`records` with `shard`, `slot` and `grown_shard` (the shard under the weights `grown`).

    Slots are gapless from 0 within a shard, in input order. No row is shuffled: each task
    numbers its rows by shard, the numbered rows are written, and the counts of the tasks
    before a task (tasks x shards rows) give its first slot. Equal or null keys share a
    shard but their number costs nothing: they stay dealt over the input's tasks. A null key
    is a key of its own. An empty input gives no rows.
    """
    if not weights or min([*weights, *grown]) <= 0:
        raise ValueError("weights must be positive")
    clash = {"shard", "slot", "grown_shard", "_key", "_part"} & {c.lower() for c in records.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    weights, grown = list(weights), list(grown)
    added = [("shard", T.IntegerType()), ("grown_shard", T.IntegerType()), ("_part", T.IntegerType()), ("slot", T.LongType())]
    schema = T.StructType([*records.schema.fields, *(T.StructField(*x) for x in added)])
    keyed = records.withColumn("_key", F.xxhash64(key))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, filled = TaskContext.get().partitionId(), np.zeros(len(weights), np.int64)
        for batch in batches:
            keys = batch.column("_key").to_numpy().view(np.uint64)
            shard = winners(keys, weights)
            slot = np.empty(len(shard), np.int64)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=len(weights))
            first = np.cumsum(counts) - counts
            slot[order] = np.arange(len(shard)) - np.repeat(first - filled, counts)
            filled += counts
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "_key"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(shard), pa.array(winners(keys, grown)), pa.array(np.full(len(shard), part, np.int32)), pa.array(slot)],
                names=schema.names,
            )

    dealt = cut(keyed.mapInArrow(deal, schema))
    counts = dealt.groupBy("_part", "shard").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", "shard", F.coalesce(before, F.lit(0)).alias("_first"))
    return (
        dealt.join(starts, ["_part", "shard"])
        .withColumn("slot", F.col("slot") + F.col("_first"))
        .select(*records.columns, "shard", "slot", "grown_shard")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None) -> DataFrame:
    """Rows of `docs` (doc_id, text) as doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: doc_id and the shard count decide. A null text has size 1 and the CRC
    of the empty text; other columns of `docs` are not read.
    """
    weights = list(weights) if weights else [1.0] * shards
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        docs["doc_id"],
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return rendezvous(rows, F.col("doc_id"), weights, [*weights, 1.0])
