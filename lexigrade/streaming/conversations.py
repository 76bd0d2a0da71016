"""Levels of conversations as their turns arrive.

A state per conversation holds the counts of its words by level and which turns it has seen, as
intervals, so a conversation read in order holds one interval. A turn that comes again is dropped,
in the same micro-batch or a later one; turns behind the watermark are dropped by the engine. Every micro-batch gives the
conversations that it changed, with all their counts so far.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexigrade.functions import distributions as d
from lexigrade.functions import text as t
from lexigrade.levels import LEVELS
from lexigrade.operators.joins import fits_broadcast

COUNTS = "conv_id {0}, turns long, words long, counts array<long>"
STATE = "intervals array<long>, words long, counts array<long>"


def hold_lexicon(lexicon: DataFrame, **bounds) -> Broadcast:
    """The lexicon (word, level) for the state operator, as places on the scale; refused where it is larger than a broadcast may be."""
    if not fits_broadcast(lexicon, **bounds):
        raise ValueError("the lexicon is too large to be held by every worker")
    place = {level: i for i, level in enumerate(LEVELS)}
    return lexicon.sparkSession.sparkContext.broadcast(
        {r["word"]: place[r["level"]] for r in lexicon.toLocalIterator() if r["level"] in place}
    )


def add_interval(ends: list[int], turn: int) -> bool:
    """Put a turn into sorted, flat, closed intervals that don't touch; False if it was there."""
    at = bisect_right(ends, turn)
    if at % 2 or (at and ends[at - 1] == turn):
        return False
    left, right = bool(at and ends[at - 1] == turn - 1), at < len(ends) and ends[at] == turn + 1
    if left and right:
        del ends[at - 1 : at + 1]
    elif left:
        ends[at - 1] = turn
    elif right:
        ends[at] = turn
    else:
        ends[at:at] = [turn, turn]
    return True


def turns_in(ends: list[int]) -> int:
    return sum(b - a + 1 for a, b in zip(ends[::2], ends[1::2]))


def conversation_counts(turns: DataFrame, lexicon: Broadcast, watermark: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """(conv_id, turns, words, counts by level) of a stream (conv_id, turn, text, time), in update mode.

    Of a repeated turn the first to arrive counts, in one micro-batch the one with the least text. Rows
    without a turn or a time are dropped, a null text has no words. A conversation that no row
    reaches for `idle_ms` of event time behind the watermark lets its state go.
    """
    kind = dict(turns.dtypes)["conv_id"]
    words = F.filter(t.words(F.coalesce("text", F.lit(""))), lambda w: t.is_cyrillic(w))
    rows = (
        turns.where("turn IS NOT NULL AND time IS NOT NULL")
        .withWatermark("time", watermark)
        .select("conv_id", "turn", "time", F.transform(words, F.lower).alias("words"))
    )

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ends, total, counts = ([], 0, [0] * len(LEVELS)) if not state.exists else state.get
        ends, counts = list(ends), list(counts)
        first: dict[int, list[str]] = {}
        newest = 0
        for batch in batches:
            for turn, said, time in zip(batch["turn"], batch["words"], batch["time"]):
                said = list(said)
                if turn not in first or said < first[turn]:
                    first[turn] = said
                newest = max(newest, int(time.timestamp() * 1000))
        changed = False
        for turn, said in first.items():
            if add_interval(ends, int(turn)):
                changed = True
                total += len(said)
                for word in said:
                    place = lexicon.value.get(word)
                    if place is not None:
                        counts[place] += 1
        state.update((ends, total, counts))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        if changed:
            yield pd.DataFrame({"conv_id": [key[0]], "turns": [turns_in(ends)], "words": [total], "counts": [counts]})

    return rows.groupBy("conv_id").applyInPandasWithState(
        count, COUNTS.format(kind), STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


def run_available(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what every micro-batch changes under `path`, a folder each; start again with the same checkpoint to go on."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest(written: DataFrame) -> DataFrame:
    """The last counts of every conversation with distribution and level, from what `run_available` has written."""
    known = [F.get("counts", F.lit(i)) for i in range(len(LEVELS))]
    last = written.groupBy("conv_id").agg(F.max_by(F.struct("turns", "words", "counts"), "batch").alias("_l")).select("conv_id", "_l.*")
    shares = last.withColumn("distribution", d.shares(known))
    return shares.withColumn("level", d.average_level(F.col("distribution")))
