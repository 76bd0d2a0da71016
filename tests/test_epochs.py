import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrade.operators import softmax
from lexigrade.operators.word_model import score_words
from lexigrade.plans import epochs, training


@pytest.fixture(scope="module")
def labels(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        easy = bool(rng.random() < 0.6)
        stem = "".join(rng.choice(list("бвгдаеио"), 4))
        rows.append((i, stem + ("ка" if easy else "ость"), "A1" if easy else "C1" if rng.random() < 0.9 else "B2"))
    rows += [(1000 + i, "дом", "A1") for i in range(30)] + [(2000, "редко", "C2")]
    return spark.createDataFrame(rows, "id long, text string, label string")


def plain_counts(words, grams, longest):
    x = np.zeros((len(words), len(grams)))
    for i, word in enumerate(words):
        letters = ["^", *word.lower(), "$"]
        for n in range(1, longest + 1):
            for a in range(len(letters) - n + 1):
                gram = " ".join(letters[a : a + n])
                if gram in grams:
                    x[i, grams.index(gram)] += 1
    return x


def test_gradient_equals_numpy(spark, labels):
    rng = np.random.default_rng(1)
    grams, classes = ["^", "а", "к а", "о с т", "$", "д"], ["A1", "B2", "C1", "C2"]
    model = softmax.WordModel(grams, classes, rng.normal(size=(4, 6)), rng.normal(size=4), 3)
    rows = labels.select("text", "label", (F.col("id") % 3 + 1).cast("double").alias("weight"))
    gradient, loss = epochs.batch_gradient(rows.repartition(5), model)
    data = rows.toPandas()
    x, w = plain_counts(data.text, grams, 3), data.weight.to_numpy()
    scores = x @ model.weights.T + model.bias
    p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    y = np.stack([[float(label == c) for c in classes] for label in data.label])
    want = ((p - y) * w[:, None]).T @ np.hstack([x, np.ones((len(x), 1))]) / w.sum()
    assert np.allclose(gradient, want) and loss == pytest.approx(-(w * np.log((p * y).sum(axis=1))).sum() / w.sum())


def test_schedule_and_steps():
    optimiser = epochs.AdamW(rate=1.0, decay=0.1, steps=20, warm_up=0.2)
    rates = [optimiser.rate_at(t) for t in range(1, 21)]
    assert rates[:4] == [0.25, 0.5, 0.75, 1.0] and rates[-1] == 0 and all(a > b for a, b in zip(rates[3:], rates[4:]))
    weights, first, second = np.array([[1.0, -2.0]]), 0, 0
    decayed = np.array([[1.0, 0.0]])
    moved = weights
    for t in range(1, 4):
        gradient = np.array([[0.5 * t, -1.0]])
        moved = optimiser.move(moved, gradient, decayed)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        step = (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        weights = weights - optimiser.rate_at(t) * step - optimiser.rate_at(t) * 0.1 * decayed * weights
        assert np.allclose(moved, weights)


def test_best_epoch_is_kept(spark, labels):
    model, history = epochs.train_word_epochs(labels, "id", epochs=4, batches=3, max_features=200)
    assert [r["epoch"] for r in history] == [1, 2, 3, 4] and [r["steps"] for r in history] == [3, 6, 9, 12]
    assert history[-1]["loss"] < history[0]["loss"]
    best = max(r["macro_f1"] for r in history)
    assert [r["epoch"] for r in history if r["kept"]] == [next(r["epoch"] for r in history if r["macro_f1"] == best)]
    assert model.classes == ["A1", "B2", "C1"] and best > 0.4
    assert model.predict(["бабака"])[0].argmax() == 0
    again, _ = epochs.train_word_epochs(labels.repartition(7), "id", epochs=4, batches=3, max_features=200)
    assert np.allclose(again.weights, model.weights)


def test_hook_equals_the_pipeline(spark, labels, tmp_path):
    trained = training.train_word_model(labels, "id", strengths=(1.0,), max_features=300)
    words = labels.select(F.col("text").alias("word")).unionByName(spark.createDataFrame([("",), (None,), ("Новое",), ("日本",)], "word string"))
    model = softmax.WordModel.of_pipeline(trained.model)
    model.save(spark, str(tmp_path))
    hook = score_words(words, softmax.batch_scorer(spark, softmax.WordModel.load(spark, str(tmp_path)), batch_size=7))
    pipeline = {r["word"]: r["probs"] for r in score_words(words, training.word_scorer(trained)).collect()}
    got = {r["word"]: r["probs"] for r in hook.collect()}
    assert got.keys() == pipeline.keys() and all(got[w] == pytest.approx(pipeline[w]) for w in got)
    assert tuple(softmax.unscorable(words).first()) == (words.count(), 2)
