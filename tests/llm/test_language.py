import numpy as np
import pyarrow as pa
import pytest

from lexigrade.llm import language, ngrams


def slow_grams(text, orders):
    """(order, n-gram) at every place of the text and its closing zero, cut at the zero."""
    closed = text + "\0"
    return [(n, closed[i : i + n].ljust(n, "\0")) for n in orders for i in range(len(closed))]


def test_grams_match_plain_slices():
    texts = ["Ab é", "", "日本 x9", None, "Ab é"]
    points, starts = ngrams.code_points(pa.array(texts), True)
    ends = np.append(starts[1:], len(points))
    seen = {}
    for text, a, b in zip(texts, starts, ends):
        mine = [h for hashes in ngrams.grams(points, (1, 2, 3)) for h in hashes[a:b].tolist()]
        folded = (text or "").lower().replace("9", "0")
        want = slow_grams(folded, (1, 2, 3))
        assert len(mine) == len(want)
        for h, g in zip(mine, want):
            assert seen.setdefault(g, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sums_are_the_features_times_weights():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(1 << ngrams.BITS, 3))
    points, starts = ngrams.code_points(pa.array(["some text", "x", "und noch einer, länger"]), True)
    got = ngrams.sums(points, starts, weights)
    for k, (a, b) in enumerate(zip(starts, np.append(starts[1:], len(points)))):
        at, values = ngrams.features(points[a:b], np.ones(1 << ngrams.BITS))
        assert got[k] == pytest.approx(values @ weights[at], rel=1e-4)


def test_document_frequency_counts_rows(spark):
    docs = spark.createDataFrame([("ab",), ("ab ab",), ("c" * 9000 + "ab",), (None,)], "text string").repartition(3)
    counts, rows = ngrams.document_frequency(docs)
    points, _ = ngrams.code_points(pa.array(["ab"]), True)
    h = [g[0] for g in ngrams.grams(points)]
    assert rows == 4
    assert counts[h[0]] == 3 and counts[h[1]] == 3


def test_penalties_leave_weights_at_zero():
    rng = np.random.default_rng(1)
    leader = language.Leader(50, 2, l1=0.5)
    for _ in range(400):
        label = int(rng.integers(2))
        leader.step(np.array([label, 2 + int(rng.integers(40))]), np.array([1.0, 0.05]), label)
    w = leader.weights()
    assert w[0, 0] > 0.1 > -0.1 > w[0, 1] and (w[2:42] == 0).mean() > 0.9


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(2)
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in language.softmax(logits)])
    assert language.temperature(logits * 4, labels) == pytest.approx(4, rel=0.15)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    assert len(held) > 250 and (held["lang"] == held["lang_pred"]).mean() >= 0.99


def test_odd_rows(spark):
    rows = [(1, "the cat sat on the mat", "en", 1), (2, "der hund und die katze", "de", 2), (4, None, "en", 3), (5, "123 !?", "de", 4),
            (None, "the dog", None, 5), (1, "the cat sat on the mat", "en", 1), (7, "", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _h int").selectExpr("*", "1 as held_out", "2 as score")
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    assert [r["lang_pred"] for r in got if r["doc_id"] in (4, 5, 7)] == ["und"] * 3
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    nothing = language.identify(docs.withColumn("lang", docs["lang"].substr(1, 0)).where("doc_id is null")).collect()
    assert [r["lang_pred"] for r in nothing] == ["und"]
    assert language.identify(docs.limit(0)).count() == 0


def test_long_and_repeated_texts(spark):
    """A text of a million letters is scored whole, and equal rows have equal scores."""
    english, german = "the cat sat on the mat ", "der hund und die katze "
    rows = [(i, english * (1 + i % 3), "en") for i in range(20)] + [(100 + i, german * (1 + i % 3), "de") for i in range(20)]
    rows += [(500, german * 50_000, None), (501, german * 50_000, None), (502, english + german * 40_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert len(got) == len(rows) and {got[i]["lang_pred"] for i in (500, 501, 502)} == {"de"}
    assert got[500]["score"] == got[501]["score"] > 0.5
