import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexigrade.llm import shards


def test_growing_moves_rows_into_the_new_shard_only():
    keys = np.random.default_rng(1).integers(0, 2**63, 40_000, dtype=np.uint64)
    old, new = shards.winners(keys, [1.0] * 16), shards.winners(keys, [1.0] * 17)
    assert set(new[new != old]) == {16}
    assert (new != old).mean() == pytest.approx(1 / 17, abs=0.01)
    counts = np.bincount(old, minlength=16)
    assert counts.max() < 1.15 * counts.min()


def test_weights_are_shares():
    keys = np.random.default_rng(2).integers(0, 2**63, 60_000, dtype=np.uint64)
    got = np.bincount(shards.winners(keys, [1.0, 2.0, 5.0])) / len(keys)
    assert got == pytest.approx([1 / 8, 2 / 8, 5 / 8], abs=0.01)
    less = shards.winners(keys, [1.0, 2.0, 4.0])
    moved = less != shards.winners(keys, [1.0, 2.0, 5.0])
    assert set(shards.winners(keys, [1.0, 2.0, 5.0])[moved]) == {2}  # a lighter shard only gives rows away


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = shards.shard_documents(docs).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    slots = {}
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = shards.shard_documents(docs.repartition(7)).collect()
    assert {(r["doc_id"], r["shard"]) for r in again} == {(r["doc_id"], r["shard"]) for r in got}


def test_hot_keys_and_odd_rows(spark):
    rows = [(1, None), (None, ""), (None, "é")] + [(2, "same")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"slot": F.lit(1), "law": F.lit("x")})
    got = shards.shard_documents(docs).collect()
    assert len(got) == len(rows)
    assert len({r["shard"] for r in got if r["doc_id"] == 2}) == 1
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    assert Counter((r["shard"], r["slot"]) for r in got).most_common(1)[0][1] == 1
    assert {r["size"] for r in got} == {1, 3, 5}
    assert shards.shard_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        shards.shard_documents(docs, weights=[1.0, 0.0])


def mixed(x):
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def plain_winner(doc_id, n):
    key = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42)

    def draw(s):
        return 1 / -math.log(((mixed(key ^ mixed(s)) >> 11) + 0.5) / 2**53)

    return max(range(n), key=lambda s: (draw(s), -s))


def test_whole_table_against_a_plain_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = shards.shard_documents(docs).collect()
    assert len(got) == docs.count()
    assert all((r["shard"], r["grown_shard"]) == (plain_winner(r["doc_id"], 16), plain_winner(r["doc_id"], 17)) for r in got)


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "é" * 2_000_000), (2, "a")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in shards.shard_documents(docs).collect()}
    assert got[1]["size"] == 4_000_001 and got[1]["text_crc32"] == zlib.crc32(("é" * 2_000_000).encode())
