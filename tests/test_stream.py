import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrade.levels import LEVELS
from lexigrade.streaming import conversations as c

SCHEMA = "conv_id long, turn long, text string, time timestamp"
LEXICON = {"дом": "A1", "кот": "A2", "мир": "B1", "суть": "C2"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-8, 8)))
def test_intervals_are_a_set(turns):
    ends, seen = [], set()
    for turn in turns:
        assert c.add_interval(ends, turn) == (turn not in seen)
        seen.add(turn)
        assert c.turns_in(ends) == len(seen) and ends == sorted(ends)
        assert all(b + 1 < a for b, a in zip(ends[1::2], ends[2::2]))


def turns_of(rng, conversations, start):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, 9)):
            text = rng.choice([None, "", "Дом и кот.", "мир дом xyz 12", "суть " * 5])
            rows.append((conv, turn, text, start + dt.timedelta(seconds=60 * conv + turn)))
    return rows


def plain(rows):
    out = {}
    for conv, _, text, _ in {(r[0], r[1]): r for r in rows if r[1] is not None}.values():
        words = [w for w in "".join(x if x.isalpha() else " " for x in (text or "").lower()).split() if w.isalpha() and not w.isascii()]
        turns, total, counts = out.setdefault(conv, [0, 0, [0] * 6])
        out[conv] = [turns + 1, total + len(words), [n + sum(LEXICON.get(w) == level for w in words) for n, level in zip(counts, LEVELS)]]
    return out


@pytest.mark.parametrize("pieces, restart", [(1, False), (4, False), (4, True)])
def test_any_split_gives_the_batch_result(spark, tmp_path, pieces, restart):
    rng = random.Random(pieces)
    rows = turns_of(rng, 12, dt.datetime(2024, 1, 1))
    again = rows + rng.sample(rows, 10) + [(3, None, "дом", dt.datetime(2024, 1, 1)), (4, 99, "кот", None)]
    rng.shuffle(again)
    lexicon = c.hold_lexicon(spark.createDataFrame(list(LEXICON.items()), "word string, level string"))
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = c.run_available(c.conversation_counts(stream, lexicon, "1 day"), out, checkpoint)
        query.awaitTermination()

    for k in range(pieces):
        spark.createDataFrame(again[k::pieces], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if restart:
            run()
    if not restart:
        run()
    kept = [r for r in again if r[1] is not None and r[3] is not None]
    got = {r["conv_id"]: [r["turns"], r["words"], list(r["counts"])] for r in c.latest(spark.read.parquet(out)).collect()}
    assert got == plain(kept)
    for r in c.latest(spark.read.parquet(out)).collect():
        assert (r["level"] == "Unknown") == (sum(r["counts"]) == 0)


def test_late_turns_are_dropped(spark, tmp_path):
    lexicon = c.hold_lexicon(spark.createDataFrame(list(LEXICON.items()), "word string, level string"))
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    day = dt.datetime(2024, 1, 10)
    batches = [[(1, 0, "дом", day)], [(2, 0, "кот", day + dt.timedelta(hours=9))], [(1, 1, "кот", day - dt.timedelta(days=2)), (1, 2, "мир", day + dt.timedelta(hours=9))]]
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        c.run_available(c.conversation_counts(stream, lexicon, "1 hour", idle_ms=86_400_000), out, checkpoint).awaitTermination()
    got = {r["conv_id"]: (r["turns"], r["words"]) for r in c.latest(spark.read.parquet(out)).collect()}
    assert got == {1: (2, 2), 2: (1, 1)}
    with pytest.raises(ValueError):
        c.hold_lexicon(spark.createDataFrame(list(LEXICON.items()), "word string, level string"), max_rows=2)
    assert spark.read.parquet(out).where(F.col("conv_id").isNull()).count() == 0
