"""Sum-of-squares packing: few sequences of whole documents.

A piece goes where the sum, over the room that sequences have left, of the squared number of
open sequences with that room grows least: no room is hoarded that nothing may fit. Pieces come in falling length,
and once as many sequences are open as the tokens fill at least, another is opened only for a
piece that fits in none. Pieces are dealt to shards of bounded size, each packed by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrade.llm.common import bounded, cut
from lexigrade.llm.packing import crc, default_files
from lexigrade.llm.tokens import encoder

WINDOW = 2048
END = 0
#: Pieces that one task packs at once; a shard wastes about one sequence in 5,000.
SHARD_PIECES = 1 << 14

PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_lengths(total: int, window: int) -> list[int]:
    """Lengths of the pieces of a document: full windows, and what is left of them in front."""
    rest = total % window
    return [rest] * (rest > 0) + [window] * (total // window)


def pieces_of(docs: DataFrame, files: tuple[str, ...], window: int) -> DataFrame:
    """Pieces without their ids, numbered; the sequence of a full one is its own."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(*files), np.array([END])
        number = TaskContext.get().partitionId() << 40
        for batch in bounded(batches, "text"):
            rows = []
            texts = batch.column("text").fill_null("").to_pylist()
            for doc, found in zip(batch.column("doc_id").to_pylist(), coder.encode(texts)):
                ids = np.append(found, end.astype(found.dtype))
                start = 0
                for piece, length in enumerate(cut_lengths(len(ids), window)):
                    number += 1
                    full = length == window
                    rows.append((doc, piece, start, length, crc(ids[start : start + length]), number << 1 if full else None, 0, number))
                    start += length
            kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 6
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "number"]
            yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(scan, f"{PLACED}, number long")


def place(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each piece; lengths are 1 to `window` - 1.

    Equal growth goes to the sequence with the least room, and to an open one before a new one.
    """
    open_with = [[] for _ in range(window)]  # open sequences by the room they have
    count = np.zeros(window + 1, np.int64)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened, enough = 0, -(-int(lengths.sum()) // window)
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        # What moving a sequence from room r to r - size adds to the squares, r from `size` on.
        fits = count[size:window]
        growth = 2 * (count[: window - size] - fits) + 2
        growth[0] = 1 - 2 * fits[0]
        growth[fits == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(growth))
        if fits[best] and (opened >= enough or growth[best] <= 2 * count[window - size] + 1):
            room = size + best
            count[room] -= 1
            at = open_with[room].pop()
        else:
            room, at = window, opened
            opened += 1
        sequence[k], offset[k] = at, window - room
        if room > size:
            count[room - size] += 1
            open_with[room - size].append(at)
    return sequence, offset


def pack(docs: DataFrame, files: tuple[str, ...] | None = None, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces of all `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of the tokenizer and a closing 0; null counts as empty, an empty
    text is the closing id alone. A document that fits is never cut. Texts are
    tokenized once, where they are read, and only the places and checksums of their pieces travel. Repeated rows and
    ids are separate documents, as many as there may be: pieces are dealt by number. Other columns are not
    read. An empty table gives no rows.
    """
    files = files or default_files()
    pieces = cut(pieces_of(docs, files, window))
    parts = pieces.where("sequence_id is null")
    shards = max(1, -(-parts.count() // shard_pieces))

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by("number").combine_chunks()
        sequence, offset = place(table.column("length").to_numpy(), window)
        base = (table.column("shard")[0].as_py() << 40) + sequence
        return table.select(names[:5]).append_column("sequence_id", pa.array(base * 2 + 1)).append_column("offset", pa.array(offset))

    names = [c.split()[0] for c in PLACED.split(", ")]
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInArrow(shard, PLACED)
    return pieces.where("sequence_id is not null").select(names).unionByName(packed)
