"""A word model as plain numbers: letter n-gram counts, weights, classes. Scored in batches by a hook.

The model is sized by its vocabulary and classes alone. It is saved as two small files of rows and shipped to
the workers as one broadcast, which each of them unpacks once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, IndexToString
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrade.levels import LEVELS


def letter_grams(word: str, longest: int) -> list[str]:
    """Letters and letter n-grams of the lower-cased word, its ends marked, n-grams joined by blanks."""
    letters = ["^", *word.lower(), "$"]
    return [" ".join(letters[i : i + n]) for n in range(1, longest + 1) for i in range(len(letters) - n + 1)]


def softmax(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


@dataclass
class WordModel:
    """p(class | word) = softmax of `weights` (classes by grams) times gram counts plus `bias`."""

    grams: list[str]
    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    longest: int

    def __post_init__(self) -> None:
        self.place = {gram: i for i, gram in enumerate(self.grams)}

    def counts(self, word: str) -> tuple[list[int], list[int]]:
        found = Counter(i for g in letter_grams(word, self.longest) if (i := self.place.get(g)) is not None)
        return list(found), list(found.values())

    def predict(self, words: list[str]) -> np.ndarray:
        scores = np.tile(self.bias, (len(words), 1))
        for row, word in enumerate(words):
            at, n = self.counts(word)
            scores[row] += self.weights[:, at] @ np.array(n, float) if at else 0.0
        return softmax(scores)

    def on_scale(self, words: list[str]) -> np.ndarray:
        """Probabilities in the order of the level scale; levels that were not trained get 0."""
        out = np.zeros((len(words), len(LEVELS)))
        found = self.predict(words)
        for i, name in enumerate(self.classes):
            if name in LEVELS:
                out[:, LEVELS.index(name)] = found[:, i]
        return out

    def save(self, spark: SparkSession, folder: str) -> None:
        rows = [(i, g, self.weights[:, i].tolist()) for i, g in enumerate(self.grams)]
        spark.createDataFrame(rows, "place int, gram string, weights array<double>").write.mode("overwrite").parquet(f"{folder}/grams")
        rows = [(i, c, float(self.bias[i]), self.longest) for i, c in enumerate(self.classes)]
        spark.createDataFrame(rows, "place int, class string, bias double, longest int").write.mode("overwrite").parquet(f"{folder}/classes")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> WordModel:
        grams = sorted(spark.read.parquet(f"{folder}/grams").collect(), key=lambda r: r["place"])
        classes = sorted(spark.read.parquet(f"{folder}/classes").collect(), key=lambda r: r["place"])
        weights = np.array([r["weights"] for r in grams]).reshape(len(grams), len(classes)).T
        names, bias = [r["class"] for r in classes], np.array([r["bias"] for r in classes])
        return cls([r["gram"] for r in grams], names, weights, bias, classes[0]["longest"])

    @classmethod
    def of_pipeline(cls, model: PipelineModel) -> WordModel:
        """The numbers of a model from `train_word_model`."""
        vectors = next(s for s in model.stages if isinstance(s, CountVectorizerModel))
        regression = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
        names = next(s for s in model.stages if isinstance(s, IndexToString)).getLabels()
        longest = max([1, *(len(g.split(" ")) for g in vectors.vocabulary)])
        weights, bias = regression.coefficientMatrix.toArray(), regression.interceptVector.toArray()
        if len(weights) == 1 and len(names) == 2:  # a binary fit gives the second class alone
            weights, bias = np.vstack([-weights, weights]) / 2, np.concatenate([-bias, bias]) / 2
        return cls(list(vectors.vocabulary), list(names), weights, bias, longest)


def batch_scorer(spark: SparkSession, model: WordModel, batch_size: int = 4096) -> Callable[[DataFrame], DataFrame]:
    """The model as the (word) → (word, probs) function of `score_words`, called batch by batch in the workers."""
    held = spark.sparkContext.broadcast((model.grams, model.classes, model.weights, model.bias, model.longest))

    def load():
        ready = WordModel(*held.value)
        return lambda words: ready.on_scale([str(w) for w in words])

    score = predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return lambda words: words.select("word", score("word").alias("probs"))


def unscorable(words: DataFrame) -> DataFrame:
    """(words, empty): how many words there are and how many of them are null or blank, which no model scores."""
    blank = F.coalesce(F.trim(F.col("word")) == "", F.lit(True))
    return words.agg(F.count(F.lit(1)).alias("words"), F.count_if(blank).alias("empty"))
