import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lexigrade.operators.word_model import score_words
from lexigrade.plans import training


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(11)
    easy, hard = ["дом", "кот", "мама"], ["обстоятельство", "закономерность", "предпосылка"]
    rows = []
    for i in range(90):
        words = rng.choice(easy if i % 3 else hard, 6)
        rows.append((i, " ".join(words) + ".", "A1" if i % 3 else "C1"))
    return spark.createDataFrame(rows, "doc_id long, text_ru string, label string")


def test_regression_is_at_its_optimum(spark, corpus):
    model = training.fit_classifier(
        corpus, ["text_ru"], [], max_features=20, ngram_max=1
    )
    regression = model.stages[-2]
    rows = model.transform(corpus).select(
        vector_to_array("features").alias("x"), vector_to_array("probability").alias("p"), "label"
    ).toPandas()
    x, p = np.stack(rows.x), np.stack(rows.p)
    names = training.class_names(model)
    y = np.stack([[float(label == n) for n in names] for label in rows.label])
    weights = regression.coefficientMatrix.toArray()
    gradient = (p - y).T @ x / len(x) + weights / len(x)
    assert np.abs(gradient).max() < 5e-3
    assert np.abs((p - y).mean(axis=0)).max() < 5e-3


def test_text_classifier_learns_and_loads(spark, corpus, tmp_path):
    trained = training.train_text_classifier(corpus, "doc_id", max_features=50)
    values = {
        (r.metric, r.label, r.pred): r.value for r in trained.metric_rows().collect()
    }
    assert values["accuracy", None, None] == 1.0
    assert values["confusion", "A1", "A1"] == 12 and values["confusion", "C1", "A1"] == 0
    trained.write(str(tmp_path))
    loaded = training.load_model(str(tmp_path))
    frame, _ = training.feature_frame(
        corpus.withColumn("text_en", F.lit("")), "doc_id", english=False
    )
    a = training.level_probabilities(trained.model, frame, "doc_id").orderBy("doc_id").collect()
    b = training.level_probabilities(loaded, frame, "doc_id").orderBy("doc_id").collect()
    assert a == b and all(sum(r.probs) == pytest.approx(1) for r in a)
    assert spark.read.json(str(tmp_path / "metrics")).count() == len(values)


def test_word_model_scores_distinct_words(spark, corpus):
    labels = corpus.select(
        "doc_id", F.explode(F.split(F.rtrim(F.regexp_replace("text_ru", "[.]", "")), " ")).alias("text"), "label"
    ).withColumn("id", F.monotonically_increasing_id())
    rare = spark.createDataFrame([(10**12, "редко", "B2")], "id long, text string, label string")
    labels = labels.select("id", "text", "label").unionByName(rare)
    trained = training.train_word_model(labels, "id", strengths=(1.0,))
    assert training.class_names(trained.model) == ["A1", "C1"]
    words = spark.createDataFrame([("дом",), ("дом ",), ("обстоятельство",), ("",)], "word string")
    probs = {r.word: r.probs for r in score_words(words, training.word_scorer(trained)).collect()}
    assert set(probs) == {"дом", "обстоятельство"}
    assert probs["дом"][0] > 0.5 and probs["обстоятельство"][4] > 0.5 and probs["дом"][1] == 0.0
