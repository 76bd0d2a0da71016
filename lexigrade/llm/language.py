"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all rows that may be learned from. The model is fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample, most weights
stay exactly zero, and a temperature fitted on further sampled rows calibrates its scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrade.llm import ngrams
from lexigrade.llm.common import bounded

UNDETERMINED = "und"
#: Distinct texts that are sampled of each language, about: four fifths to fit, the rest to calibrate.
SAMPLE = 1000


class Leader:
    """FTRL-proximal for a softmax over classes, with L1 and L2 penalties and a rate for every weight."""

    def __init__(self, size: int, classes: int, rate: float = 0.2, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> None:
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2
        self.z, self.n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -free / ((self.beta + np.sqrt(n)) / self.rate + self.l2)

    def step(self, buckets: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(buckets, len(self.z) - 1), np.append(values, 1.0)  # the last row is the intercept
        w = self.weights(at)
        g = x[:, None] * (softmax(x @ w) - np.eye(self.z.shape[1])[label])
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rate * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section over 1/20 to 20.

    The labels weigh (n + 1) / (n + 2) instead of 1, else scores of separable rows go to 1.
    """
    classes = max(logits.shape[1], 2)
    target = np.full(logits.shape, 1 / (len(labels) + 2) / (classes - 1))
    target[np.arange(len(labels)), labels] = (len(labels) + 1) / (len(labels) + 2)

    def loss(t: float) -> float:
        return float(-(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-12))).sum(axis=1).mean())

    low, high, ratio = -np.log(20), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, with IDF multiplied in
    intercept: np.ndarray
    temperature: float


def fit(docs: DataFrame, sample: int = SAMPLE, epochs: int = 4, seed: int = 6) -> Model:
    """Learns from `docs` (text, lang): frequencies from all its rows, weights from about `sample`
    distinct texts of each language (equal texts are drawn together and count once)."""
    known = docs.where("lang is not null and text is not null").select("text", "lang")
    frequency, rows = ngrams.document_frequency(known)
    idf = np.log((1 + rows) / (1 + frequency)) + 1
    keyed = known.withColumn("_h", F.xxhash64("text"))
    sizes = {r["lang"]: r["n"] for r in keyed.groupBy("lang").agg(F.approx_count_distinct("_h").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << ngrams.BITS, 0), np.float32), np.zeros(0), 1.0)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample / max(n, 1)))) for k, n in sizes.items()])
    drawn = keyed.where(F.pmod("_h", F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["lang", "_h"])
    held = docs.sparkSession.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", ngrams.SLICE):
            points, starts = ngrams.code_points(batch.column("text"), True)
            ends = np.append(starts[1:], len(points))
            found = [ngrams.features(points[a:b], held.value) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_h"), batch.column("lang"), pa.array([b.astype(np.int32).tobytes() for b, _ in found]), pa.array([v.tobytes() for _, v in found])],
                names=["h", "lang", "buckets", "values"],
            )

    got = drawn.mapInArrow(vectors, "h long, lang string, buckets binary, values binary").toPandas()
    got = got.sort_values(["h", "lang"], kind="stable")
    items = [
        (np.frombuffer(b, np.int32), np.frombuffer(v, np.float32), languages.index(k))
        for b, v, k in zip(got["buckets"], got["values"], got["lang"])
    ]
    order = np.random.default_rng(seed).permutation(len(items))
    calibrating = order[: len(order) // 5]
    fitting = order[len(order) // 5 :]
    leader = Leader(1 << ngrams.BITS, len(languages))
    for epoch in range(epochs):
        for i in np.random.default_rng([seed, epoch]).permutation(fitting):
            leader.step(*items[i])
    w = leader.weights()
    logits = np.array([items[i][1] @ w[items[i][0]] + w[-1] for i in calibrating]).reshape(-1, len(languages))
    labels = np.array([items[i][2] for i in calibrating], int)
    heat = temperature(logits, labels) if len(labels) else 1.0
    return Model(languages, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], heat)


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score"), keep_text: bool = False) -> DataFrame:
    """`docs`, without `text` unless it is kept, with the predicted language and its calibrated probability.

    Whole texts, no shuffle. A null text or one without a letter is `und` with score 0, as is
    every text where no language was learned. The two `names` must be free.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in docs.schema.fields if keep_text or f.name != "text"])
    kept = schema.names
    schema = T.StructType([*schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        values = np.array([*m.languages, UNDETERMINED], object)
        for batch in bounded(batches, "text", ngrams.SLICE):
            n = batch.num_rows
            best, score = np.full(n, len(m.languages)), np.zeros(n)
            lettered = pc.match_substring_regex(batch.column("text").fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
            if m.languages:
                points, starts = ngrams.code_points(batch.column("text"), True)
                p = softmax((ngrams.sums(points, starts, m.weights) + m.intercept) / m.temperature)
                best = np.where(lettered, p.argmax(axis=1), best)
                score = np.where(lettered, p.max(axis=1), 0.0)
            columns = [batch.column(name) for name in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values[best], pa.string()), pa.array(score)], names=[*kept, *names])

    return docs.mapInArrow(scan, schema)


def remainder(docs: DataFrame, modulus: int):
    """crc32 of doc_id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % modulus


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Every row of `docs` (doc_id, text, lang) as doc_id, held_out, lang_pred, score.

    Learns from rows whose id's crc32 is not 1 modulo 3. An empty table gives no rows. Texts are
    scored whole at any length, repeated rows alike and one by one; other columns are not read.
    """
    fold = remainder(docs, 3)
    model = fit(docs.where(fold != 1).select("text", "lang"), sample)
    return predict(docs.select(docs["doc_id"], (fold == 1).alias("held_out"), docs["text"]), model)
