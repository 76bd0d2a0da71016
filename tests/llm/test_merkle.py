import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lexigrade.llm import merkle

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fan):
    """Root over hashes in order, and each one's (before, behind) from the bottom up."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = range(0, len(nodes), fan)
        for a in runs:
            run = nodes[a : a + fan]
            for k in range(len(run)):
                for leaf in owners[a + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
        owners = [sum(owners[a : a + fan], []) for a in runs]
        nodes = [h("".join(nodes[a : a + fan])) for a in runs]
    return nodes[0], paths


def brute_force(rows, fan=16):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(sources[s], key=lambda x: x[:3])], fan) for s in order}
    root, upper = climb([trees[s][0] for s in order], fan) if order else ("", [])
    out = []
    for s, onward in zip(order, upper):
        for (_, _, leaf, row), path in zip(sorted(sources[s], key=lambda x: x[:3]), trees[s][1]):
            at = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                at = leaf_of([*row[:4], row[4].translate(lower)])
            for before, behind in path + onward:
                at = h(before + at + behind)
            proof = h("".join(a + b for a, b in path + onward))
            out.append((row[0], leaf, trees[s][0], root, proof, at, at == root))
    return sorted(out, key=repr)


def result(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=repr)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = brute_force(rows)
    assert result(merkle.audit(docs)) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("n", [1, 4, 17, 65])
def test_heights(spark, n):
    rows = [(i, "a" if i else "b", "en", i, f"Text {i}") for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(merkle.audit(docs, fan=4)) == brute_force(rows, 4)


def test_odd_rows(spark):
    long = "A long text, é. " * 100_000
    rows = [(None, None, None, None, None), (1, "", "en", 0, ""), (1, "", "en", 0, ""), (1, "", "en", 0, "B"), (5, "é", None, 3, long),
            (5, None, "x", 1, "Q"), (-3, "Z", "", -1, "-"), (10**15, "a", "en", 2, None), *[(7, "hot", "en", 1, "SAME")] * 70]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = result(merkle.audit(docs.withColumns({n: F.lit(1) for n in ("group", "lo", "SIZE", "hash", "path", "leaf", "_run", "_number")})))
    assert got == brute_force(rows)
    assert merkle.audit(docs.limit(0)).count() == 0


def test_intervals(spark):
    rows = [(i, f"s{i % 3}", "en", i, str(i)) for i in range(100)]
    _, levels, upper = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fan=3)
    for tree in (levels, upper):
        for number, level in enumerate(tree):
            below = {}
            for r in level.collect():
                below.setdefault(r["group"], []).append((r["lo"], r["hi"]))
                assert r["hi"] - r["lo"] <= 3**number and r["lo"] % 3**number == 0
            for spans in below.values():
                spans.sort()
                assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
