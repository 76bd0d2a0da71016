import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import fixtures as fx
from lexigrade.operators import joins, metrics, numeric, sampling, tfidf, word_model
from lexigrade.operators.lexicon import attach_lemma_level, attach_level, build_lexicon
from lexigrade.plans import grading, training
from lexigrade.sources import corpora
from lexigrade.streaming.grading import grade_stream, stream_text_features
from lexigrade.functions.features import with_text_features


def test_last_duplicate_wins(spark):
    raw = spark.createDataFrame(
        [(1, "Дом", "A1"), (2, " дом ", "B1 "), (3, " ", "C1")], "row_id long, word string, level string"
    )
    assert [tuple(r) for r in build_lexicon(raw).collect()] == [("дом", "B1")]


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [(i, "и" if i % 3 == 0 else (None if i % 3 == 1 else f"w{i}")) for i in range(3000)]
    table = [("и", 1), *[(f"w{i}", i) for i in range(0, 3000, 2)]]
    return (
        spark.createDataFrame(rows, "id long, k string"),
        spark.createDataFrame(table, "k string, v long"),
    )


def test_salted_lookup_equals_broadcast(spark, skewed):
    left, table = skewed
    plain = joins.lookup_join(left, table, "k", row_key=["id"])
    salted = joins.lookup_join(left, table, "k", row_key=["id"], max_rows=1, rows_per_task=100)
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))
    assert salted.count() == 3000


def test_hot_keys_name_the_frequent_ones(skewed):
    left, _ = skewed
    assert {r.k: r._parts for r in joins.hot_keys(left, "k", 100).collect()} == {"и": 10}


def test_size_check(skewed):
    _, table = skewed
    assert joins.fits_broadcast(table)
    assert not joins.fits_broadcast(table, max_rows=100)
    assert not joins.fits_broadcast(table, max_bytes=100)


def test_level_lookups_agree_on_both_ways(spark):
    tokens = spark.createDataFrame(
        [(1, "Дома"), (2, "кот"), (3, ""), (4, "лес"), (5, None)], "id long, token string"
    )
    lexicon = spark.createDataFrame([("дом", "A1"), ("лес", "B2")], "word string, level string")
    lemmas = spark.createDataFrame([("дома", "дом"), ("лес", "x")], "token string, lemma string")
    for bounds in ({}, {"max_rows": 0, "rows_per_task": 1}):
        levels = attach_level(tokens, lexicon, "token", row_key=["id"], **bounds)
        assert {r.id: r.level for r in levels.collect()} == {
            1: "Unknown", 2: "Unknown", 3: "Unknown", 4: "B2", 5: "Unknown",
        }
        both = attach_lemma_level(tokens, lexicon, lemmas, "token", row_key=["id"], **bounds)
        assert {r.id: r.level for r in both.collect()} == {
            1: "A1", 2: "Unknown", 3: "Unknown", 4: "B2", 5: "Unknown",
        }


def test_translation_wins_when_given(spark):
    texts = spark.createDataFrame(
        [(1, "а", "своё"), (2, "а", ""), (3, "б", None), (4, "в", None)],
        "pair_id long, kaz string, rus string",
    )
    table = spark.createDataFrame([("а", "перевод"), ("б", "другой")], "src_text string, tgt_text string")
    for bounds in ({}, {"max_rows": 0, "rows_per_task": 1}):
        rows = grading.with_translation(texts, table, ["pair_id"], **bounds).collect()
        assert {r.pair_id: (r.rus, r.translation_used) for r in rows} == {
            1: ("своё", False), 2: ("перевод", True), 3: ("другой", True), 4: ("", True),
        }


def test_word_features_agree_on_both_ways(spark):
    texts = spark.createDataFrame([(1, "да нет да"), (2, "12"), (3, "иное")], "id long, x string")
    probs = spark.createDataFrame(
        [("да", [.5, .1, .1, .1, .1, .1]), ("нет", [.1, .5, .1, .1, .1, .1])],
        "word string, probs array<double>",
    )
    for bounds in ({}, {"max_rows": 0, "rows_per_task": 1}):
        got = {
            r["id"]: r
            for r in word_model.word_distribution_features(texts, probs, "id", "x", **bounds).collect()
        }
        assert got[1]["word_cefr_prob_A1"] == pytest.approx(1.1 / 3)
        assert got[1]["word_cefr_ratio_A1"] == pytest.approx(2 / 3)
        assert got[1]["word_cefr_token_count"] == 3.0
        assert got[2]["word_cefr_token_count"] == 0.0 and got[2]["word_cefr_prob_A1"] == 0.0
        assert got[3]["word_cefr_token_count"] == 1.0 and got[3]["word_cefr_ratio_A1"] == 0.0


@pytest.mark.parametrize("batch", [1, 5, 1 << 20])
def test_terms_are_counted_where_they_are_cut(spark, monkeypatch, batch):
    docs = ["аа бб аа бб", "бб", "", None, "вв вв вв гг", "аа бб"] * 3
    frame = spark.createDataFrame([(d,) for d in docs], "x string")
    monkeypatch.setattr(tfidf, "BATCH_TERMS", batch)
    lists = [[" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)] for w in ((d or "").split() for d in docs)]
    rows = tfidf.term_counts(frame, "x", 3)
    got = {r["term"]: (r["tf"], r["df"]) for r in rows.collect()}
    assert got == {t: (sum(d.count(t) for d in lists), sum(t in d for d in lists)) for d in lists for t in d}
    assert "Generate" not in rows._jdf.queryExecution().executedPlan().toString()


def test_word_report_flags_texts_without_words(spark):
    texts = spark.createDataFrame([(1, "б а"), (2, "…")], "pair_id long, rus string")
    probs = word_model.score_words(
        texts.select(F.explode(F.split("rus", " ")).alias("word")), fx.digest_word_model
    )
    rows = {r.pair_id: r for r in grading.word_report(texts, probs).collect()}
    assert [w.word for w in rows[1].words] == ["б", "а"] and not rows[1].no_tokens
    assert rows[2].no_tokens


@pytest.mark.parametrize("partitions", [1, 7, 32])
def test_split_is_the_same_for_any_partitioning(spark, partitions):
    rows = [(i, "abc"[i % 3] if i % 10 else "d") for i in range(1003)]
    frame = spark.createDataFrame(rows, "id long, label string").repartition(partitions)
    got = {r.id for r in sampling.stratified_split(frame, "id").where("is_test").collect()}
    want = set()
    for label in "abcd":
        members = [i for i, name in rows if name == label]
        members.sort(key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
        want |= set(members[: round(0.2 * len(members))])
    assert got == want


def test_tiny_class_has_no_test_rows(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "a")], "id long, label string")
    assert sampling.stratified_split(frame, "id").where("is_test").count() == 0


def test_class_filter_and_checks(spark):
    raw = spark.createDataFrame(
        [(1, "да", "a1"), (2, "нет", "A1"), (3, "кот", "B1"), (4, "x", "Unknown"), (5, " ", "A1")],
        "id long, rus_item string, cefr string",
    )
    kept = sampling.keep_frequent_classes(corpora.word_labels(raw))
    assert sorted(r.text for r in kept.collect()) == ["да", "нет"]
    with pytest.raises(ValueError):
        sampling.require_classes(kept)
    with pytest.raises(ValueError):
        sampling.require_classes(kept.where("false"))


@pytest.mark.parametrize("buckets", [1024, 3])
def test_median_and_scaling(spark, monkeypatch, buckets):
    monkeypatch.setattr(numeric, "BUCKETS", buckets)
    rng = np.random.default_rng(3)
    a = [1.0, 2.0, 4.0, 10.0]
    b = [float(x) for x in rng.integers(0, 5, 2000)] + [7.5]
    c = rng.normal(size=2000).tolist()
    rows = [
        (i, a[i] if i < 4 else None, b[i], c[i] if i < 2000 else float("nan"), 3.0)
        for i in range(2001)
    ]
    frame = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    got = {r["name"]: r["median"] for r in numeric.exact_medians(frame, ["a", "b", "c", "d"]).collect()}
    assert got == pytest.approx({"a": 3.0, "b": np.median(b), "c": np.median(c), "d": 3.0})
    fitted = numeric.fit_scaling(frame.limit(4), ["a", "d"])
    assert fitted["a"] == pytest.approx((3.0, 4.25, 3.491060), abs=1e-6)
    assert fitted["d"] == (3.0, 3.0, 1.0)


def test_metrics_against_counting(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("a", "a"), ("b", "d")]
    frame = spark.createDataFrame(rows, "label string, pred string")
    assert metrics.accuracy(frame).first()[0] == pytest.approx(3 / 6)
    report = {r.label: r for r in metrics.class_report(frame).collect()}
    assert (report["a"].precision, report["a"].recall) == pytest.approx((2 / 3, 2 / 3))
    assert report["c"].f1 == 0 and report["d"].support == 0
    assert metrics.macro_f1(frame).first()[0] == pytest.approx((2 / 3 + 1 / 2 + 0 + 0) / 4)
    grid = {(r.label, r.pred): r.n for r in metrics.confusion(frame).collect()}
    assert len(grid) == 9 and grid["c", "c"] == 0 and grid["a", "a"] == 2
    shares = {r.label: r.share for r in metrics.class_distribution(frame).collect()}
    assert shares == pytest.approx({"a": 0.5, "b": 1 / 3, "c": 1 / 6})


def test_tfidf_against_counting(spark):
    docs = ["аа бб аа", "бб вв", "", "вв вв гг"]
    frame = spark.createDataFrame(list(enumerate(docs)), "id long, x string")
    got = {(r.id, r.term): r.weight for r in tfidf.tfidf_cells(frame, "id", "x", 5, 2).collect()}
    lists = [d.split() + [" ".join(p) for p in zip(d.split(), d.split()[1:])] for d in docs]
    counts = collections.Counter(t for d in lists for t in d)
    vocabulary = sorted(counts, key=lambda t: (-counts[t], t))[:5]
    df = {t: sum(t in d for d in lists) for t in vocabulary}
    want = {}
    for i, d in enumerate(lists):
        raw = {t: d.count(t) * (math.log(5 / (1 + df[t])) + 1) for t in vocabulary if t in d}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        want |= {(i, t): x / norm for t, x in raw.items()}
    assert got == pytest.approx(want)


def test_medians_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [
        tuple(float(x) for x in (rng.normal(), rng.integers(0, 3), 10.0 ** rng.integers(-9, 9), 7, rng.choice([-np.inf, 0.5, np.inf])))
        for _ in range(1501)
    ]
    for n in (1, 2, 1500, 1501):
        frame = spark.createDataFrame(rows[:n], "`a b` double, b double, c double, d double, e double")
        got = {r["name"]: r["median"] for r in numeric.exact_medians(frame, frame.columns).collect()}
        for k, name in enumerate(frame.columns):
            values = sorted(r[k] for r in rows[:n])
            want = (values[(n - 1) // 2] + values[n // 2]) / 2
            assert got[name] == want or (np.isnan(got[name]) and np.isnan(want)), (n, name)


def test_csv_files_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("kaz,rus\nk1,r1\n", encoding="utf-8")
    types = {"kaz": "string", "rus": "string"}
    assert [tuple(r) for r in corpora.read_csv(spark, str(tmp_path), types).collect()] == [("k1", "r1")]
    (tmp_path / "b.csv").write_text("rus,kaz\nr2,k2\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)header"):
        corpora.read_csv(spark, str(tmp_path), types).collect()


def test_look_ups_ignore_the_number_of_partitions(spark):
    tokens = spark.createDataFrame([(i, f"w{i % 7}") for i in range(200)], "id long, token string")
    lexicon = spark.createDataFrame([("w1", "A1"), ("l2", "B1"), ("w2", "C1"), ("w3", "A2")], "word string, level string")
    lemmas = spark.createDataFrame([("w2", "l2"), ("w3", "none"), ("w4", "w1")], "token string, lemma string")
    want = {"w0": ("w0", "Unknown"), "w1": ("w1", "A1"), "w2": ("l2", "B1"), "w3": ("none", "A2"), "w4": ("w1", "A1")}
    for parts in (1, 8, 64):
        for bounds in ({}, {"max_rows": 0, "rows_per_task": 5}):
            got = attach_lemma_level(tokens.repartition(parts), lexicon, lemmas, "token", row_key=["id"], **bounds).collect()
            assert len(got) == 200
            for r in got:
                assert (r["lemma"], r["level"]) == want.get(r["token"], (r["token"], "Unknown"))


def test_sources(spark, tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_text('kaz,extra\n"бір ""екі""\nүш",1\n', encoding="utf-8")
    raw = corpora.read_csv(spark, str(path), {"kaz": "string", "rus": "string"}, multiline=True)
    assert raw.columns == ["kaz"] and raw.first().kaz == 'бір "екі"\nүш'
    corpus = corpora.parallel_corpus(raw.select(F.lit(1).alias("pair_id"), "kaz")).first()
    assert (corpus.kaz, corpus.rus) == ('бір "екі"\nүш', "")
    bitext = spark.createDataFrame([("a\nb", "c"), ("", "d"), (" ", "e"), (None, "f")], "kk string, ru string")
    clean = corpora.ingest_bitext(bitext)
    assert sorted(map(tuple, clean.collect())) == [("", "e"), ("a b", "c")]
    assert corpora.write_counted(clean, str(tmp_path / "out")) == 2
    assert corpora.write_counted(clean, str(tmp_path / "csv"), "csv") == 2
    texts = spark.createDataFrame([(1, None, "x"), (2, "y", None)], "id int, text_ru string, label string")
    assert [tuple(r) for r in corpora.text_corpus(texts, english=False).collect()] == [(1, "x", "", "")]
    with pytest.raises(ValueError):
        corpora.text_corpus(texts)
    with pytest.raises(ValueError):
        corpora.text_columns(False, False)
    ordered = spark.createDataFrame([(i,) for i in (3, 1, 2)], "pair_id long")
    assert [r.pair_id for r in corpora.first_pairs(ordered, 2).collect()] == [1, 2]
    assert corpora.first_pairs(ordered, None).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"Мама мыла раму {i}. Да!") for i in range(20)]
    source = str(tmp_path / "in")
    frame = spark.createDataFrame(rows, "id long, x string").repartition(3)
    frame.write.parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = grade_stream(
        stream, lambda df: stream_text_features(df, "x"), str(tmp_path / "out"), str(tmp_path / "ck")
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = with_text_features(frame, "x")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
