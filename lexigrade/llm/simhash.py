"""SimHash near-duplicates: segment bit counts, a grid join under Manhattan distance, exact checks.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan
distance of two count vectors never exceeds the Hamming distance of the fingerprints, so
fingerprints at 3 bits or fewer have counts at 3 or less, and in one half of the segments at
1 or less. The halves' counts are grid cells: a fingerprint lives in its own cell and looks
into the cells one step up (a step down is the other one's step up). Those that meet pass
the whole Manhattan bound and then the exact bit comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrade.llm.common import bounded, cut, texts
from lexigrade.llm.components import components, forest

SHINGLE = 3
SEED = 42
LINK_BITS = 3
#: Fingerprints of one cell that are held at once; a cell with more is dealt to several tasks.
CELL_BLOCK = 20_000

_LOW = 0x5555555555555555
_LOWS = np.uint64(_LOW)
_PAIRS = 1 << 20


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles: a bit is set if it is in over half of the shingles' hashes."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(width, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    total, ones, size = len(last), np.zeros(64, np.int64), 1 << 15
    spans = list(zip(starts[:total].tolist(), last))
    for k in range(0, total, size):
        raw = b"".join([digest(joined[s:e], seed) for s, e in spans[k : k + size]])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every row of `docs` as doc_id, fp (the fingerprint as a signed long); null text has no word."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            fps = np.array([fingerprint(t) for t in texts(batch.column("text"))], np.uint64)
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps.view(np.int64))], names=[*names, "fp"])

    kept = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes if name != "text")
    return docs.mapInArrow(scan, f"{kept}, fp long")


def counts(bits: Column) -> Column:
    """Bit counts of the two-bit segments of 32 bits, packed two bits each."""
    return bits - F.shiftright(bits, 1).bitwiseAND(F.lit(_LOW & 0xFFFFFFFF))


def cells(distinct: DataFrame) -> DataFrame:
    """(cell, step, fp): own cells (step 0) and those one step up (step 1), for both halves."""
    rows = []
    for half in (0, 1):
        part = F.shiftright("fp", 32) if half else F.col("fp")
        own = counts(part.bitwiseAND(F.lit(0xFFFFFFFF)))
        segments = F.sequence(F.lit(0), F.lit(30), F.lit(2))
        up = F.transform(
            F.filter(segments, lambda j: F.call_function("shiftright", F.col("own"), j) % 4 < 2),
            lambda j: F.col("own") + F.call_function("shiftleft", F.lit(1).cast("long"), j),
        )
        rows.append(
            distinct.select("fp", own.alias("own"))
            .select("fp", F.posexplode(F.concat(F.array("own"), up)).alias("at", "cell"))
            .select((F.col("cell") + F.lit(half << 32)).alias("cell"), F.least("at", F.lit(1)).alias("step"), "fp")
        )
    return rows[0].unionByName(rows[1])


def links(distinct: DataFrame, bits: int = LINK_BITS, block: int = CELL_BLOCK) -> DataFrame:
    """(a, b): links that join exactly the fingerprints (column fp, all different) connected at `bits` or fewer.

    Each task compares what meets in its cells and returns one link per connected fingerprint,
    not all pairs. Cells with over `block` rows are dealt to several tasks by their own members.
    """
    if bits > 3:
        raise ValueError("one step in a half covers at most 3 differing bits")
    met = cells(distinct)
    hot = met.groupBy("cell").count().where(F.col("count") > block)
    hot = hot.select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.when(F.col("step") == 0, F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    dealt = met.join(hot, "cell", "left").select(
        "cell", "step", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part")
    )
    # Own members of the part come first; the whole cell, members included, passes by them.
    rows = dealt.select(
        "cell", "part", F.when(F.col("mine") == F.col("part"), 0).otherwise(1).alias("turn"), "fp"
    )
    spread = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "turn", "fp")
    return spread.mapInArrow(lambda batches: compare(batches, bits), "a long, b long")


def compare(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links within each (cell, part): its members (turn 0) against all that follow them, in blocks."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting, key = np.zeros(0, np.uint64), None

    def check(x: np.ndarray, y: np.ndarray) -> None:
        cx, cy = x - ((x >> np.uint64(1)) & _LOWS), y - ((y >> np.uint64(1)) & _LOWS)
        near = manhattan(cx, cy) <= bits
        x, y = x[near], y[near]
        same = (np.bitwise_count(x ^ y) <= bits) & (x != y)
        if same.any():
            found.append((x[same].view(np.int64), y[same].view(np.int64)))
            if sum(len(f[0]) for f in found) > _PAIRS:
                found[:] = [forest(*map(np.concatenate, zip(*found)))]

    def meet(members: np.ndarray, others: np.ndarray) -> None:
        step = max(1, _PAIRS // max(1, len(members)))
        for k in range(0, len(others), step):
            some = others[k : k + step]
            check(np.repeat(members, len(some)), np.tile(some, len(members)))

    for batch in batches:
        cell, part = batch.column("cell").to_numpy(), batch.column("part").to_numpy()
        turn, fp = batch.column("turn").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        if not len(fp):
            continue
        edge = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
        own = np.add.reduceat((turn == 0).astype(np.int64), starts)
        # The first group may go on from the last batch, the last one into the next.
        if (cell[0], part[0]) != key:
            waiting = np.zeros(0, np.uint64)
        members = np.concatenate([waiting, fp[: own[0]]])
        if len(members):
            meet(members, fp[: ends[0]])
            if len(waiting) and own[0]:
                meet(fp[: own[0]], waiting)
        waiting = members
        if len(starts) > 1:
            key = (cell[-1], part[-1])
            a, b = starts[-1], ends[-1]
            waiting = fp[a : a + own[-1]]
            size = ends - starts
            wide = np.arange(1, len(starts))
            wide = wide[(own[1:] > 0) & (size[1:] > 1)]
            small = wide[own[wide] * size[wide] <= 4096]
            for k in range(0, len(small), 8192):
                some = small[k : k + 8192]
                left = np.repeat(starts[some], own[some]) + within(own[some])
                times = np.repeat(size[some], own[some])
                check(fp[np.repeat(left, times)], fp[np.repeat(np.repeat(starts[some], own[some]), times) + within(times)])
            for g in wide[own[wide] * size[wide] > 4096]:
                meet(fp[starts[g] : starts[g] + own[g]], fp[starts[g] : ends[g]])
        else:
            key = (cell[0], part[0])
    if found:
        a, b = forest(*map(np.concatenate, zip(*found)))
        for k in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + (1 << 16)]), pa.array(b[k : k + (1 << 16)])], names=["a", "b"])


def within(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 for every n of `lengths`, one after the other."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of packed two-bit counts 0..2: |a - b| is 2 where one is 0 and the other 2."""
    differ = x ^ y
    odd = np.bitwise_count(differ & _LOWS)
    return odd + 2 * np.bitwise_count((differ >> np.uint64(1)) & ~differ & _LOWS)


def grouped(docs: DataFrame, bits: int = LINK_BITS) -> DataFrame:
    """Every row of `docs` (doc_id, text and others) as its columns but text, fp, root, component_id.

    `root` is the smallest fingerprint of the row's component.
    """
    printed = cut(fingerprints(docs))
    distinct = cut(printed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(links(distinct.select("fp"), bits))
    rooted = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return printed.join(by_print, "fp").select(*[c for c in printed.columns if c != "fp"], "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, bits: int = LINK_BITS) -> DataFrame:
    """Every row of `docs` (doc_id, text) as doc_id, fingerprint, component_id; other columns are not read.

    component_id is the smallest doc_id reachable over links of at most `bits` differing bits,
    null only where all those ids are null. Texts without a word have fingerprint zero and
    link like any other. Rows with one fingerprint are summed before anything is compared. An
    empty table gives no rows.
    """
    found = grouped(docs.select(docs["doc_id"], docs["text"]), bits)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, row: str, bits: int = LINK_BITS) -> DataFrame:
    """The value of the unique column `row` of the one row that stays of each component of `docs`.

    It is the row with the smallest doc_id (null last), of several the one with the least `row`.
    """
    found = grouped(docs.select(docs[row].alias("row"), docs["doc_id"], docs["text"]), bits)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    return found.groupBy("root").agg(best.alias("best")).select(F.col("best.row").alias(row))
