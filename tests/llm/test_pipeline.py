import re

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from lexigrade.llm import packing, substring
from tests.llm.test_packing import check
from tests.llm.test_simhash import slow_components, slow_print

SF = "/root/testdata/sf0.01"


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    n = min(10, len(words))
    return {n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}} if n else {}


def brute_force(docs, items):
    """Stages 2 to 4 on rows (doc_id, text), all ids different."""
    last = {}
    for doc, text in sorted(docs):
        last[fold(text)] = (doc, text)
    prints = {doc: slow_print(text) for doc, text in last.values()}
    root, first = slow_components(set(prints.values())), {}
    for doc, text in sorted(last.values()):
        first.setdefault(root[prints[doc]], (doc, text))
    known = [w for item in items for w in windows(item).items()]
    out = []
    for doc, text in first.values():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
        mine = {n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} for n in {n for n, _ in known}}
        if not any(mine[n] & w for n, w in known):
            out.append((doc, text))
    return out


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in pipeline.STAGES[:-1]:
        kept = pipeline.cut(stage(spark, kept, SF))
        assert kept.columns == docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or "")]
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted(brute_force(rows, items))
    pieces = pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert check(spark, kept.collect(), pieces, packing.WINDOW) < 0.05


def test_odd_rows(spark):
    plain = "some words that make a text of their own and go on"
    rows = [
        (1, plain, "en"), (1, plain, "en"), (1, "quite another text under the same number, longer than the first one", "en"),
        (None, "a row without a number keeps its words in the corpus like any other row", "en"), (None, None, None), (7, "12 34", "en"),
        (8, "Ein Text in einer anderen Sprache, damit es zwei davon gibt", "de"),
    ]
    docs = pipeline.cut(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"row_in_stage": F.lit(1), "kept": F.lit(2), "fp": F.lit(3)}))
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.cut(stage(spark, docs, SF))
    got = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(got, key=str) == sorted({(d, t) for d, t, _ in rows[:4] + rows[6:]}, key=str)
    assert docs.columns == ["doc_id", "text", "lang", "row_in_stage", "kept", "fp"]
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        empty = pipeline.cut(stage(spark, empty, SF))
    assert empty.count() == 0


def test_rows_keep_their_numbers_when_files_are_packed_otherwise(spark, tmp_path):
    """Each file a partition while a stage decides, all files one partition when its result is read."""
    base = "This is a story with many words number"
    rows = [(i, " ".join(f"{base} {i} {j}" for j in range(8)), "en") for i in range(24)]
    rows += [(100 + i, rows[i][1], "en") for i in range(0, 24, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    apart = {"spark.sql.files.openCostInBytes": str(128 << 20), "spark.sql.files.minPartitionNum": "6"}
    together = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}

    def shifted(step):
        try:
            for k, v in apart.items():
                spark.conf.set(k, v)
            assert docs.rdd.getNumPartitions() == 6
            result = step()
            for k, v in together.items():
                spark.conf.set(k, v)
            assert spark.read.parquet(str(tmp_path / "docs")).rdd.getNumPartitions() == 1
            return result.collect()
        finally:
            for k in apart:
                spark.conf.unset(k)

    last = {}
    for doc, text, _ in sorted(rows):
        last[text] = doc
    got = shifted(lambda: pipeline.drop_exact_copies(spark, docs, ""))
    assert sorted(r["doc_id"] for r in got) == sorted(last.values())
    first = {}
    for doc, text, _ in sorted(rows):
        first.setdefault(text, doc)
    prints = {doc: slow_print(text) for text, doc in first.items()}
    root, smallest = slow_components(set(prints.values())), {}
    for doc in sorted(prints):
        smallest.setdefault(root[prints[doc]], doc)
    got = shifted(lambda: pipeline.drop_near_copies(spark, docs, ""))
    assert sorted(r["doc_id"] for r in got) == sorted(smallest.values())
    texts = {doc: text for doc, text, _ in rows}
    for r in shifted(lambda: substring.deduplicate(docs)):
        data, at, left = texts[r["doc_id"]].encode(), 0, b""
        for s in r["spans"]:
            left, at = left + data[at : s["start"]], s["end"]
        assert (left + data[at:]).decode() == r["text"]
        assert r["doc_id"] not in (100 + i for i in range(0, 24, 3)) or r["repeated"]


CLEAN = {"en": "the cat and the dog sat on the mat with", "de": "der hund und die katze sind nicht auf dem", "es": "el perro y los gatos est\u00e1n en la mesa con", "fr": "les chiens et le chat sont dans une maison avec"}


def test_language_decides(spark):
    rows = [(i * 4 + k, f"{text} {i}", lang) for i in range(12) for k, (lang, text) in enumerate(CLEAN.items())]
    clean = {r[0] for r in rows} | {100}
    rows += [(100, CLEAN["de"], None), (101, "\u0436\u0449\u044d\u044e", None), (102, "12 34", "en"), (103, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = {r["doc_id"] for r in pipeline.identify_language(spark, docs, "").collect()}
    assert got == clean


def test_nothing_learned_keeps_lettered_documents(spark):
    rows = [(1, CLEAN["en"], None), (2, "\u65e5\u672c", None), (3, "12 34", None), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in pipeline.identify_language(spark, docs, "").collect()} == {1, 2}
