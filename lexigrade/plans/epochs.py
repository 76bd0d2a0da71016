"""The word model trained in epochs: mini-batches, AdamW, warm-up and decay, the best epoch kept.

The rows are written once, parted by batch. A step reads its batch alone; every task adds up the
gradient of its rows, the parts are summed by Spark, and the driver, which holds nothing but the weights
and their moments, moves the weights. Sizes on the driver are those of the model.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrade.functions import text as t
from lexigrade.operators import metrics
from lexigrade.operators.sampling import keep_frequent_classes, require_classes, stratified_split
from lexigrade.operators.softmax import WordModel
from lexigrade.session import ensure_checkpoint_dir, materialise


@dataclass
class AdamW:
    """Moments of one array of weights. The decay is apart from the gradient."""

    rate: float
    decay: float
    steps: int
    warm_up: float = 0.1
    betas: tuple[float, float] = (0.9, 0.999)
    epsilon: float = 1e-8

    def __post_init__(self) -> None:
        self.t, self.first, self.second = 0, None, None

    def rate_at(self, step: int) -> float:
        """Rises in a line over the first steps, then falls in a line to 0."""
        warm = max(1, round(self.warm_up * self.steps))
        return self.rate * (step / warm if step <= warm else max(0.0, (self.steps - step) / max(1, self.steps - warm)))

    def move(self, weights: np.ndarray, gradient: np.ndarray, decayed: np.ndarray) -> np.ndarray:
        self.t += 1
        b1, b2 = self.betas
        self.first = gradient * (1 - b1) + (0 if self.first is None else b1 * self.first)
        self.second = gradient**2 * (1 - b2) + (0 if self.second is None else b2 * self.second)
        step = (self.first / (1 - b1**self.t)) / (np.sqrt(self.second / (1 - b2**self.t)) + self.epsilon)
        return weights - self.rate_at(self.t) * (step + self.decay * decayed * weights)


def batch_gradient(rows: DataFrame, model: WordModel) -> tuple[np.ndarray, float]:
    """Gradient of the weighted mean loss over `rows` (text, label, weight) as (classes, grams + 1), bias last, and the loss.

    Tasks send the cells that are not zero, as many as the model has at most.
    """
    held = rows.sparkSession.sparkContext.broadcast((model.grams, model.classes, model.weights, model.bias, model.longest))
    width = len(model.grams) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = WordModel(*held.value)
        index = {c: i for i, c in enumerate(ready.classes)}
        total, loss, mass = np.zeros((len(ready.classes), width)), 0.0, 0.0
        for batch in batches:
            words = batch.column("text").to_pylist()
            if not words:
                continue
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            truth = np.array([index[label] for label in batch.column("label").to_pylist()])
            scores = ready.predict(words)
            each = np.arange(len(words))
            loss -= float(weight @ np.log(np.maximum(scores[each, truth], 1e-300)))
            mass += float(weight.sum())
            scores[each, truth] -= 1.0
            scores *= weight[:, None]
            total[:, -1] += scores.sum(axis=0)
            for row, word in enumerate(words):
                at, n = ready.counts(word)
                if at:
                    total[:, at] += np.outer(scores[row], n)
        cells = total.ravel()
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([cells[at], [loss, mass]]))], names=["cell", "part"]
        )

    parts = rows.select("text", "label", "weight").mapInArrow(run, "cell long, part double")
    summed = dict(parts.groupBy("cell").agg(F.sum("part")).toLocalIterator())
    held.destroy()
    loss, mass = summed.pop(-1, 0.0), summed.pop(-2, 0.0)
    gradient = np.zeros(len(model.classes) * width)
    gradient[list(summed)] = list(summed.values())
    return gradient.reshape(len(model.classes), width) / max(mass, 1e-300), loss / max(mass, 1e-300)


def scored(words: DataFrame, model: WordModel) -> DataFrame:
    """`words` (text, …) with `pred`, the likeliest class (the first of equal ones)."""
    held = words.sparkSession.sparkContext.broadcast((model.grams, model.classes, model.weights, model.bias, model.longest))
    schema = T.StructType([*words.schema.fields, T.StructField("pred", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = WordModel(*held.value)
        for batch in batches:
            best = ready.predict(batch.column("text").to_pylist()).argmax(axis=1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([ready.classes[k] for k in best], pa.string())], names=schema.names)

    return words.mapInArrow(run, schema)


def train_word_epochs(
    labels: DataFrame,
    id_col: str,
    *,
    epochs: int = 5,
    batches: int = 8,
    rate: float = 0.05,
    decay: float = 0.01,
    warm_up: float = 0.1,
    test_size: float = 0.2,
    seed: int = 42,
    max_features: int = 2000,
    longest: int = 3,
) -> tuple[WordModel, list[dict]]:
    """The word model after its best epoch, and every epoch's {epoch, steps, loss, macro_f1, kept}.

    `labels` is (id, text, label); classes with one row are left out. Equal (text, label) rows train as one
    weighted row. A row's batch comes from a digest of its text; the batches' order changes with the epoch. Of
    equally good epochs the first is kept.
    """
    spark = labels.sparkSession
    usable = keep_frequent_classes(materialise(labels.select(id_col, "text", "label")))
    require_classes(usable)
    split = materialise(stratified_split(usable, id_col, test_size=test_size, seed=seed).select("text", "label", "is_test"))
    weighed = split.groupBy("text", "label", "is_test").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    weighed = weighed.withColumn("batch", F.pmod(F.xxhash64("text"), F.lit(batches)).cast("int"))
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/epochs-{uuid.uuid4().hex}"
    weighed.write.partitionBy("is_test", "batch").parquet(path)
    rows = spark.read.schema(weighed.schema).parquet(path)
    train, held_out = rows.where(~F.col("is_test")), rows.where("is_test")

    letters = F.split(F.concat(F.lit("^"), F.lower("text"), F.lit("$")), "")
    listed = train.select(F.explode(t.ngrams(letters, longest)).alias("gram"), "weight").groupBy("gram").agg(F.sum("weight").alias("n"))
    vocabulary = [r["gram"] for r in listed.orderBy(F.desc("n"), "gram").limit(max_features).collect()]
    classes = sorted(r["label"] for r in split.select("label").distinct().collect())
    model = WordModel(vocabulary, classes, np.zeros((len(classes), len(vocabulary))), np.zeros(len(classes)), longest)

    order = np.random.default_rng(seed)
    optimiser = AdamW(rate, decay, epochs * batches, warm_up)
    decayed = np.ones((1, len(vocabulary) + 1))
    decayed[0, -1] = 0.0
    history, best = [], None
    for epoch in range(1, epochs + 1):
        losses = []
        for b in order.permutation(batches).tolist():
            gradient, loss = batch_gradient(train.where(F.col("batch") == b), model)
            whole = optimiser.move(np.hstack([model.weights, model.bias[:, None]]), gradient, decayed)
            model = WordModel(vocabulary, classes, whole[:, :-1], whole[:, -1], longest)
            losses.append(loss)
        counted = scored(held_out.select("text", "label", "weight"), model).groupBy("label", "pred").agg(F.sum("weight").cast("long").alias("n"))
        score = metrics.macro_f1(materialise(counted)).first()["macro_f1"] or 0.0
        history.append({"epoch": epoch, "steps": epoch * batches, "loss": float(np.mean(losses)), "macro_f1": score})
        if best is None or score > best[0]:
            best = (score, epoch, model)
    for record in history:
        record["kept"] = record["epoch"] == best[1]
    return best[2], history

