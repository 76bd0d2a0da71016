import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lexigrade.llm import simhash
from lexigrade.llm.components import components


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """{print: smallest print reachable} by comparing all pairs."""
    values = np.array(sorted(prints), np.uint64)
    root = {int(v): int(v) for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for v in values:
        for w in values[np.bitwise_count(values ^ v) <= 3]:
            a, b = sorted((find(int(v)), find(int(w))))
            root[b] = a
    return {v: find(v) for v in root}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    prints = {d: slow_print(t) for d, t in texts.items()}
    root = slow_components(set(prints.values()))
    smallest = {}
    for d, p in prints.items():
        smallest[root[p]] = min(d, smallest.get(root[p], d))
    want = {d: (f"{p:016x}", smallest[root[p]]) for d, p in prints.items()}
    got = simhash.near_duplicates(docs.select("doc_id", "text")).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want
    assert len(got) == len(texts)


def test_crowded_cells_match_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    values = set()
    for c in centre:
        for _ in range(400):
            v = int(c)
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    want = slow_components(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for block in (20_000, 50):
        found = simhash.links(frame, 3, block)
        assert found.count() < 20 * len(values)
        got = {r["node"] % 2**64: r["root"] % 2**64 for r in components(found).collect()}
        groups = {}
        for v in values:
            groups.setdefault(got.get(v, v), set()).add(v)
        expected = {}
        for v in values:
            expected.setdefault(want[v], set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 2), (None, "  ", 3), (7, "a b c d e f", 4), (7, "a b c d e f", 4), (2, "word", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp_ long").withColumn("component", F.lit(1))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert {by[k]["component_id"] for k in [5, 3, None]} == {3}
    assert by[3]["fingerprint"] == "0" * 16
    assert by[2]["component_id"] == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
