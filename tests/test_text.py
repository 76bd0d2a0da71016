import random
import re

import pytest
from pyspark.sql import functions as F

from lexigrade.functions import distributions as d
from lexigrade.functions import scan
from lexigrade.functions import text as t
from lexigrade.functions.features import TEXT_FEATURES, with_text_features
from lexigrade.operators import tfidf, word_model


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x"))).first()[0]


def test_words(spark):
    text = "12ab3 x_y ½cup don’t мектепке-де"
    assert one(spark, text, t.words) == ["ab", "x", "y", "½cup", "don’t", "мектепке-де"]


def test_endless_hyphen_chain_does_not_overflow(spark):
    chain = "-".join(["а"] * 200_000)
    assert one(spark, chain, lambda c: F.size(t.words(c))) == 1
    assert one(spark, chain, t.is_cyrillic) is True
    numbers = ".".join(["1"] * 200_000)
    assert one(spark, numbers, lambda c: F.size(t.numbers(c))) == 1


@pytest.mark.parametrize(
    "text, n", [("3.14 is pi", 2), ("Hi. . .", 3), ("...", 0), ("a\nb", 1), ("", 0)]
)
def test_sentences(spark, text, n):
    assert len(one(spark, text, t.sentences)) == n


@pytest.mark.parametrize(
    "word, n", [("no", 1), ("Кот-учёный", 4), ("ходит", 2), ("", 0), ("оаe", 1), ("ода", 2)]
)
def test_syllables(spark, word, n):
    assert one(spark, word, t.syllables) == n


def test_latin_ending_takes_one_group(spark):
    assert one(spark, "молоко", t.syllables) == 3
    assert one(spark, "молокоe", t.syllables) == 2
    assert one(spark, "молокоes", t.syllables) == 2


@pytest.mark.parametrize(
    "token, ok",
    [
        ("мектепке", True), ("по-русски", True), ("д’арк", True), ("Ёж", True), (" дом ", True),
        ("қала", False), ("слово-", False), ("schön", False), ("", False), ("дом1", False),
    ],
)
def test_cyrillic(spark, token, ok):
    assert one(spark, token, t.is_cyrillic) is ok
    assert one(spark, token, t.is_informative) is ok


def test_strip_covers_unicode_blanks(spark):
    assert one(spark, " \t Дом \n", t.strip_lower) == "дом"


def features(spark, text):
    frame = with_text_features(spark.createDataFrame([(text,)], "x string"), "x")
    return {n: frame.first()[n] for n in TEXT_FEATURES}


def test_features(spark):
    got = features(spark, "Мама мыла раму. Мама устала!")
    assert (got["sentence_count"], got["token_count"], got["type_count"]) == (2, 5, 4)
    assert got["type_token_ratio"] == pytest.approx(0.8)
    assert got["syllable_count"] == 11
    assert got["average_syllables_per_word"] == pytest.approx(2.2)
    assert got["long_word_percentage"] == pytest.approx(20.0)
    got = features(spark, "Цена 3,50 и 3.50, код 007_a; цена 3,50")
    assert (got["number_count"], got["token_count"], got["type_count"]) == (3, 5, 4)
    assert (got["sentence_count"], got["average_sentence_length"]) == (2, 2.5)
    assert got["syllable_count"] == 7
    assert set(features(spark, "").values()) == {0}
    assert set(features(spark, None).values()) == {0}


def test_ngrams(spark):
    assert one(spark, "A bb ccc dd", lambda c: t.terms(c, 2)) == [
        "bb", "ccc", "dd", "bb ccc", "ccc dd",
    ]
    assert one(spark, "a", lambda c: t.terms(c, 2)) == []
    assert one(spark, "ab cd", lambda c: t.terms(c, 3)) == ["ab", "cd", "ab cd"]


def test_words_without_numbers(spark):
    frame = spark.createDataFrame([(["a", "b", "a", "7"], ["7", "b"])], "w array<string>, n array<string>")
    kept = frame.select(t.words_without_numbers(F.col("w"), F.col("n"))).first()[0]
    assert kept == ["a", "a"]


@pytest.mark.parametrize("a, b, want", [(3, 0, 0.0), (0, 5, 0.0), (4, 2, 2.0), (1, None, 0.0)])
def test_safe_ratio(spark, a, b, want):
    frame = spark.createDataFrame([(a, b)], "a int, b int")
    assert frame.select(t.safe_ratio(F.col("a"), F.col("b"))).first()[0] == want


@pytest.mark.parametrize(
    "counts, level",
    [
        ([2, 0, 1, 0, 0, 0], "A2"),
        ([0, 0, 1, 1, 0, 0], "B1"),
        ([0, 1, 1, 0, 0, 0], "B1"),
        ([1, 1, 0, 0, 0, 0], "A1"),
        ([0, 0, 0, 0, 0, 0], "Unknown"),
    ],
)
def test_average_level_rounds_half_to_even(spark, counts, level):
    frame = spark.createDataFrame([(counts,)], "c array<int>")
    shares = d.shares([F.get("c", F.lit(i)) for i in range(6)])
    row = frame.select(shares.alias("d")).select("d", d.average_level(F.col("d")).alias("l")).first()
    assert row["l"] == level
    assert sum(row["d"]) == pytest.approx(1.0 if sum(counts) else 0.0)


def test_blend(spark):
    model, zero = [0.1, 0.2, 0.3, 0.2, 0.1, 0.1], [0.0] * 6
    frame = spark.createDataFrame([(model, zero)], "m array<double>, k array<double>")
    mixed = d.blend(F.col("m"), F.col("k"), 0.6)
    row = frame.select(mixed.alias("p"), d.top_level(mixed).alias("l")).first()
    assert row["p"] == pytest.approx(model) and row["l"] == "B1"
    both = d.blend(F.col("k"), F.col("k"), 0.6)
    row = frame.select(both.alias("p"), d.top_level(both).alias("l")).first()
    assert row["p"] == pytest.approx([1 / 6] * 6) and row["l"] == "A1"
    with pytest.raises(ValueError):
        d.blend(F.col("m"), F.col("k"), 1.5)


def test_softmax_and_empty_distribution(spark):
    assert one(spark, [1000.0, 1000.0], d.softmax, "array<double>") == pytest.approx([0.5, 0.5])
    assert one(spark, None, d.top_level, "array<double>") is None
    assert one(spark, [], d.top_probability, "array<double>") == 0.0


def test_scan_finds_what_the_patterns_find(spark):
    """Odd and random texts against the expressions of `functions.text`, character by character of every class."""
    rng = random.Random(4)
    odd = ["", " ", "...", ". . a", "a.  ", "a.  b!? ", "\0a\0.", "мама'мама’-мама--а-", "1.2,3 1.2 1,,2 ٣٤.٥", "ΑΣ'Σ Ας ας İ i̇ ß", "ъъе aes аeаes", "x\U0001f600y ²³Ⅷ Ⅷ ⅷ", "-a-", "'", "é é", "Ᲊ Ɤ"]
    letters = list("аяеЕaeS'’-.!?,19²Ⅷ \n\t\0 ́Σσςİ\U0001d400٠_")
    odd += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*odd, None])], "id int, text string").repartition(3)
    text = F.coalesce("text", F.lit(""))
    words = t.words(text)
    sizes = F.transform(words, lambda w: t.syllables(w))
    want = df.select(
        "id",
        F.size(t.sentences(text)), F.size(F.array_distinct(t.numbers(text))), F.size(words), F.size(F.array_distinct(F.transform(words, F.lower))),
        F.aggregate(sizes, F.lit(0), lambda a, x: a + x), F.size(F.filter(sizes, lambda x: x > 2)),
    )
    got = df.select("id", scan.text_statistics(spark, F.col("text")).alias("s")).select("id", "s.*")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    listed = df.select("id", F.explode(words).alias("word"))
    counted = word_model.word_counts(df, "id", "text")
    assert {tuple(r) for r in counted.where("n > 0").collect()} == {tuple(r) for r in listed.groupBy("id", "word").count().collect()}
    assert {r["id"] for r in counted.where("word IS NULL AND n = 0").collect()} == {r["id"] for r in df.where(F.size(words) == 0).collect()}
    assert {r["word"] for r in word_model.distinct_words(df, "text").collect()} == {r["word"] for r in listed.collect()}
    terms = df.select("id", F.explode(t.terms(text, 2)).alias("term")).groupBy("term").agg(F.count("id"), F.count_distinct("id"))
    assert {tuple(r) for r in tfidf.term_counts(df, "text", 2).collect()} == {tuple(r) for r in terms.collect()}


def test_scan_parts_change_nothing(spark, monkeypatch):
    texts = ["один два", "", "три три Три. 1 2 1", "x" * 50]
    table = scan.kinds(scan.ranges(spark))
    whole = [x.tolist() for x in scan._statistics(scan.Scan(texts, table), re.compile("[аеио]+"))]
    monkeypatch.setattr(scan, "PART_CHARS", 5)
    found = [scan._statistics(part, re.compile("[аеио]+")) for _, part in scan.parts(texts, table)]
    assert len(found) == 4 and [[int(x[0]) for x in column] for column in zip(*found)] == whole


def test_text_features_run_no_patterns(spark):
    plan = with_text_features(spark.range(1).selectExpr("CAST(id AS string) AS text"), "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan
