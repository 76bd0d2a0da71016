import hashlib
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import functions as F

from lexigrade.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(text, items, window=10):
    found, hit, names = words(text), set(), set()
    for item, item_text in items:
        w = words(item_text)
        n = min(window, len(w))
        patterns = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(found) - n + 1):
            if tuple(found[i : i + n]) in patterns:
                hit.update(range(i, i + n))
                names.add("" if item is None else str(item))
    return len(found), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def result(docs, items, **limits):
    got = decontaminate.report(decontaminate.find(docs, items, **limits)).collect()
    return {r["doc_id"]: tuple(r)[1:] for r in got}


def test_few_words_in_many_orders(spark):
    """A small alphabet makes overlaps, short items and repeats frequent."""
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(120)]
    items = [(i, text(n)) for i, n in enumerate([0, 1, 3, 4, 5, 6, 8, 9, 10, 11, 12, 15, 40])][2:]
    items += [(50, "É x Y-z"), (51, "q " * 25), (51, "other words")]
    docs += [(500, "é X y, z"), (501, "q " * 30), (502, "other, words. Other")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_force(t, items) for i, t in docs}
    assert result(d, b) == want
    assert result(d, b, pass_words=20) == want  # many passes


def test_pieces_of_long_items_lose_no_window(spark):
    rng = random.Random(8)
    item = " ".join(rng.choice("abcdefgh") for _ in range(400))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    pieces = [bytes(r["words"]).split() for r in decontaminate.pieces(items, 10, 25).collect()]
    assert max(map(len, pieces)) == 25
    got = {tuple(p[i : i + 10]) for p in pieces for i in range(len(p) - 9)}
    w = item.encode().split()
    assert got == {tuple(w[i : i + 10]) for i in range(len(w) - 9)}


def test_passes_are_bounded_and_hold_every_piece(spark):
    """Items of many tasks; a pass is one file, and a long run of documents meets each of them."""
    rng = random.Random(10)
    text = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    items = [(i, text(rng.randint(0, 90))) for i in range(60)]
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(5)
    files = decontaminate.written_passes(benchmark, 100, 10, 30)
    held = [pq.read_table(SparkFiles.get(name)).column("words").to_pylist() for name in files]
    assert len(files) > 10 and max(sum(len(w.split()) for w in words) for words in held) <= 100
    want = [bytes(r["words"]) for r in decontaminate.pieces(benchmark, 10, 30).collect()]
    assert sorted(w for words in held for w in words) == sorted(want)
    docs = [(i, text(rng.randint(0, 80))) for i in range(150)]
    got = result(spark.createDataFrame(docs, "doc_id long, text string"), benchmark, pass_words=100, piece_words=30)
    assert got == {i: brute_force(t, items) for i, t in docs}


def test_batches_are_gathered_whole():
    batches = [pa.record_batch({"text": ["x" * 100]}) for _ in range(7)]
    assert [len(g) for g in decontaminate.gathered(iter(batches), 0)] == [1] * 7
    assert [len(g) for g in decontaminate.gathered(iter(batches), 250)] == [3, 3, 1]


def test_crowded_bucket():
    patterns = [(i, [f"w{i}".encode(), b"x", *[b"y"] * 8]) for i in range(30)]
    searcher = decontaminate.Searcher(patterns, 10)
    text = [b"z", b"w7", b"x", *[b"y"] * 9]
    assert searcher.search(text) == [(1, 10, {7})]


def test_odd_rows(spark):
    rows = [(1, None, 1), (None, "", 2), (2, "one two three", 3), (2, "one two three", 3), (3, "--- !!", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").withColumn("item_id", F.lit(1))
    items = [(None, "two"), (4, None), (5, "..."), (6, "two three"), (6, "two three")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(1))
    got = decontaminate.report(decontaminate.find(docs, benchmark)).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], *tuple(r)[1:]) for r in got} == {(d, *brute_force(t, items)) for d, t, _ in rows}
    assert not any(r["contaminated"] for r in decontaminate.report(decontaminate.find(docs, benchmark.limit(0))).collect())
    assert decontaminate.find(docs.limit(0), benchmark).count() == 0


def test_long_and_repeated_documents(spark):
    """A window at the end of a long text is found, and each of several equal rows has its own result."""
    rng = random.Random(9)
    item = " ".join(f"term{i}" for i in range(14))
    long = " ".join(rng.choice("abcdefgh") for _ in range(300_000)) + " " + item
    docs = spark.createDataFrame([(1, long), (2, long), (2, long), (3, long[:-1])], "doc_id long, text string")
    got = decontaminate.report(decontaminate.find(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got) == [
        (1, 300_014, 14, 1), (2, 300_014, 14, 1), (2, 300_014, 14, 1), (3, 300_014, 13, 1)]
