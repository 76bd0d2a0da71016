import hashlib
import re

from pyspark.sql import functions as F

from lexigrade.llm import exact


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_force(rows):
    """Rows (doc_id, text) in order to (doc_id, keep_id, group_size, kept, text_sha256)."""
    groups = {}
    for place, (doc, text) in enumerate(rows):
        groups.setdefault(fold(text), []).append((doc is not None, doc or 0, -place))
    out = []
    for place, (doc, text) in enumerate(rows):
        mine = groups[fold(text)]
        known, keep, turn = max(mine)
        out.append((doc, keep if known else None, len(mine), turn == -place, hashlib.sha256(fold(text).encode()).hexdigest()))
    return out


def result(frame):
    return [tuple(r) for r in frame.drop("row").select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(result(exact.deduplicate(docs))) == sorted(brute_force(rows))


def test_odd_rows(spark):
    long = "Some words, and more of them.\n" * 2000
    rows = [(1, None), (5, ""), (None, "a"), (None, "A"), (2, "É"), (3, "é"), (7, "x"), (7, "X"), (7, "x"),
            (8, long), (9, long.upper()), (10, long + "."), (11, "." + long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumns({"row": F.lit(1), "recipe": F.lit(2), "kept": F.lit(3)})
    assert sorted(result(exact.deduplicate(docs)), key=str) == sorted(brute_force(rows), key=str)
    assert exact.deduplicate(docs.limit(0)).count() == 0


def test_chunks_cover_and_resync(spark):
    body = " ".join(f"word{i * 7919 % 1000} and number {i}." for i in range(3000))
    moved = "Something in front. " + body
    got = spark.createDataFrame([(body,), (moved,), ("\n" * 20_000,), ("日本語" * 9000,)], "text string")
    lists = [r[0] for r in got.select(exact.chunks(F.col("text"))).collect()]
    assert ["".join(parts) for parts in lists] == [body, moved, "\n" * 20_000, "日本語" * 9000]
    assert all(len(c) <= exact.LONGEST + 4 for parts in lists for c in parts)
    assert len(set(lists[0]) & set(lists[1])) > len(lists[0]) / 2


def test_chunks_that_share_a_key_stay_apart(spark):
    occurrences = spark.createDataFrame([(1, b"a"), (1, b"b"), (1, b"a"), (2, b"a")], "key long, check binary")
    got = {(r["key"], bytes(r["check"])): r["nth"] for r in exact.identifiers(occurrences).collect()}
    assert got == {(1, b"a"): 1, (1, b"b"): 2, (2, b"a"): 1}


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = exact.deduplicate(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
