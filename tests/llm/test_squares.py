import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexigrade.llm import squares


def plain_place(lengths, window):
    """The rule by its definition: the sum over all rooms is computed anew for every choice."""
    rooms, where = [], [None] * len(lengths)
    enough = -(-sum(lengths) // window)

    def squares_of(rooms):
        counts = defaultdict(int)
        for r in rooms:
            counts[r] += 0 < r < window
        return sum(n * n for r, n in counts.items() if r)

    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        size, choices = lengths[k], []
        for room in sorted({r for r in rooms if r >= size}):
            at = max(i for i, r in enumerate(rooms) if r == room)
            choices.append((squares_of([*rooms[:at], room - size, *rooms[at + 1 :]]), 0, room))
        if not choices or len(rooms) < enough:
            choices.append((squares_of([*rooms, window - size]), 1, window))
        _, new, room = min(choices)
        if new:
            rooms.append(window)
        where[k] = room
        at = len(rooms) - 1 if new else rooms.index(room)
        rooms[at] -= size
    return where, len(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=40))
def test_rule(lengths):
    sequence, offset = squares.place(np.array(lengths, np.int64), 16)
    where, opened = plain_place(lengths, 16)
    assert [16 - o for o in offset.tolist()] == where
    assert len(set(sequence.tolist())) == opened
    held = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths):
        held[s].append((o, n))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 16


def check(docs, pieces, window):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = False
    want = defaultdict(list)
    for r in docs:
        want[r["doc_id"]].append([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0])
    found, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        found[p["doc_id"]].append((p["piece"], p["start"], p["length"], p["ids_crc32"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for doc, texts in want.items():
        expected = []
        for ids in texts:
            cuts = list(range(len(ids), 0, -window))[::-1]
            for k, (a, b) in enumerate(zip([0, *cuts], cuts)):
                expected.append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
        assert sorted(found.pop(doc)) == sorted(expected)
    assert not found
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences), -(-sum(p["length"] for p in pieces) // window)


@pytest.mark.parametrize("shard_pieces", [1 << 14, 200])
def test_documents(spark, shard_pieces):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    used, least = check(docs.collect(), squares.pack(docs, shard_pieces=shard_pieces).collect(), 2048)
    assert used <= least * (1.02 if shard_pieces > 200 else 1.05)


def test_few_sequences():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(6.3, 1, 20_000).astype(np.int64) + 1, 2047)
    sequence, _ = squares.place(lengths, 2048)
    assert sequence.max() + 1 <= 1.002 * lengths.sum() / 2048 + 1


def test_odd_rows(spark):
    rows = [(1, None, 1), (None, "", 2), (2, "a b", 3), (2, "a b", 3), (3, "word " * 9000, 4), (4, "a " * 2047, 5), (5, "<|endoftext|>", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").selectExpr("*", "1 as SHARD", "2 as number", "3 as piece")
    check(docs.collect(), squares.pack(docs).collect(), 2048)
    assert squares.pack(docs.limit(0)).count() == 0
