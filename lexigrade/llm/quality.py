"""Quality classification by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled text train a logistic model. The loss of positives taken as
negatives is subtracted from that of the unlabelled, weighted by the class prior, and what is
left of the negative risk is kept from falling below zero. Only the positives are a bounded
sample: means, spreads, the prior and every step's unlabelled risk are sums over all rows.
Inputs are statistics of the whole text: what it is written with, how its lines and words are
built, and how much of it repeats. They are taken once and written, a short list per row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrade.llm import ngrams
from lexigrade.llm.common import bounded, cut, free_name, texts
from lexigrade.llm.language import remainder

THRESHOLD = 0.3
#: Trusted positives that are sampled, about.
SAMPLE = 8_000
#: Steps of a fit at most, halved ones included, and the weight of the squared weights in the risk.
STEPS, DECAY = 40, 2e-4
STATISTICS = 14


def statistics(points: np.ndarray, starts: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Square roots of the shares of capitals, digits, signs, stops, spaces and line feeds, then length, repetition and build of words and lines of each text."""
    count = np.maximum(np.diff(np.append(starts, len(points))) - 1, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.sqrt(np.add.reduceat(mask, starts, dtype=np.int64) / count)

    capitals = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    digits = (points >= 48) & (points <= 57)
    spaces = (points <= 32) & (points > 0)
    lines = points == 10
    signs = (points > 32) & (points < 127) & ~digits & ~((points >= 65) & (points <= 90)) & ~((points >= 97) & (points <= 122))
    plain = (points == 46) | (points == 44)
    words = np.zeros((len(raw), 7))
    for i, text in enumerate(raw):
        found = text.split()
        n = len(found)
        if n:
            counted = Counter(found)
            pairs = len(set(zip(found, found[1:])))
            words[i] = (
                len(counted) / n,
                sum(map(bytes.__eq__, found[1:], found)) / n,
                max(counted.values()) / n,
                pairs / max(n - 1, 1),
                len(text) / n,
                sum(map(len, set(text.split(b"\n")))) / len(text),
                np.log1p(n),
            )
    shares = [share(capitals), share(digits), share(signs & ~plain), share(plain), share(spaces), share(lines), np.log1p(count)]
    return np.concatenate([np.stack(shares, axis=1), words], axis=1)


def inputs(column: pa.Array) -> np.ndarray:
    points, starts = ngrams.code_points(column, False)
    return statistics(points, starts, list(texts(column)))


def measure(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with the statistics of the whole text, the list `name`, in place of `text`; no shuffle."""
    kept = [field for field in docs.schema.fields if field.name != "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", ngrams.SLICE):
            x = inputs(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, STATISTICS), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), lists], names=[*(f.name for f in kept), name])

    return docs.mapInArrow(scan, T.StructType([*kept, T.StructField(name, T.ArrayType(T.DoubleType()))]))


@dataclass
class Model:
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    intercept: float
    prior: float

    def score(self, name: str) -> Column:
        """The score as an expression over the list of statistics `name`."""
        total = F.lit(float(self.intercept))
        for i, (m, s, w) in enumerate(zip(self.middle.tolist(), self.spread.tolist(), self.weights.tolist())):
            total += F.greatest(F.least((F.get(name, F.lit(i)) - m) / s, F.lit(6.0)), F.lit(-6.0)) * w
        return 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))))


def standard(x: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised statistics and a column of ones."""
    return np.append(np.clip((x - middle) / spread, -6, 6), np.ones((len(x), 1)), axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: Sums a function of (standardised rows, half of each row, 0 or 1) over all unlabelled rows.
Gather = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def curvature(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows, summed loss as negatives, its gradient and its second derivatives, one after the other."""
    f = x @ w
    s = sigmoid(f)
    return np.concatenate([[len(x), np.logaddexp(0, f).sum()], x.T @ s, ((x.T * (s * (1 - s))) @ x).ravel()])


def minimise(positives: list[np.ndarray], gather: Gather, halves: list[int | None], prior: float, starts: list[np.ndarray]) -> list[np.ndarray]:
    """Weights (last: intercept) of least non-negative unbiased risk under the logistic loss, one per problem.

    risk = prior * R(positive as 1) + R(unlabelled as 0) - prior * R(positive as 0), whose second
    part, the negative risk, can't be negative for a true prior. A problem takes the unlabelled rows of its
    half, or all (None); one pass over the rows serves a step of every problem. The risk is convex, as
    the two losses of a positive differ by its score, so the steps are Newton's; one that would raise the risk or
    bring the negative risk below zero is halved, and a fit ends where no step is left.
    """
    size = len(starts[0])
    ridge = np.append(np.full(size - 1, DECAY), 1e-9)
    at, risk, step = [w.copy() for w in starts], [np.inf] * len(starts), [np.zeros(size) for _ in starts]
    live = [True] * len(starts)
    for turn in range(STEPS):
        tried = [w + d for w, d in zip(at, step)]

        def sums(x: np.ndarray, half: np.ndarray, tried=tried) -> np.ndarray:
            return np.concatenate([curvature(x if h is None else x[half == h], w) for h, w in zip(halves, tried)])

        for k, total in enumerate(np.split(gather(sums), len(starts))):
            if not live[k]:
                continue
            w, rows = tried[k], max(total[0], 1)
            fp = positives[k] @ w
            negative = total[1] / rows - prior * np.logaddexp(0, fp).mean()
            now = prior * np.logaddexp(0, -fp).mean() + negative + (ridge * w * w).sum() / 2
            if turn and (now > risk[k] + 1e-12 or negative < 0):
                step[k] = step[k] / 2
                live[k] = np.abs(step[k]).max() > 1e-5
                continue
            at[k], risk[k] = w, now
            gradient = total[2 : 2 + size] / rows - prior * positives[k].mean(axis=0) + ridge * w
            step[k] = -np.linalg.solve(total[2 + size :].reshape(size, size) / rows + np.diag(ridge), gradient)
            live[k] = -gradient @ step[k] > 1e-9
        if not any(live):
            break
    return at


def estimate_prior(positive: np.ndarray, gather: Gather, rounds: int = 3) -> float:
    """The share of positives among the unlabelled, from scores that part positives and unlabelled.

    Whatever set of scores is taken, it holds at least prior times its share of the positives,
    so the least ratio of the two shares bounds the prior. The sets are those above low
    quantiles of the positives' scores, and each half of the rows is scored by a fit on the
    other. A better bound gives a better fit, which gives the next round's bound.
    """
    prior, found = 0.5, [np.zeros(positive.shape[1])] * 2
    for _ in range(rounds):
        # Started afresh, as the weights of the round before may have a negative risk below zero under the new prior.
        found = minimise([positive[0::2], positive[1::2]], gather, [0, 1], prior, [np.zeros(positive.shape[1])] * 2)
        scores = [positive[1 - k :: 2] @ found[k] for k in (0, 1)]
        cuts = [np.quantile(p, [0.01, 0.02, 0.05, 0.1, 0.2, 0.3]) for p in scores]

        def above(x: np.ndarray, half: np.ndarray, found=found, cuts=cuts) -> np.ndarray:
            parts = []
            for k in (0, 1):
                other = x[half == 1 - k] @ found[k]
                parts += [[len(other)], (other[:, None] >= cuts[k]).sum(axis=0)]
            return np.concatenate(parts).astype(float)

        ratios = np.zeros(6)
        for total, p, c in zip(np.split(gather(above), 2), scores, cuts):
            ratios += total[1:] / max(total[0], 1) / np.maximum((p[:, None] >= c).mean(axis=0), 1e-9) / 2
        prior = float(np.clip(ratios.min(), 0.01, 0.99))
    return prior


def gatherer(measured: DataFrame, middle: np.ndarray, spread: np.ndarray) -> Gather:
    """Sums over all rows of `measured` (doc_id, x): each task adds up its own, Spark the tasks'."""
    rows = measured.select("x", F.pmod(F.xxhash64("doc_id", "x"), F.lit(2)).alias("half"))

    def gather(part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)
                    here = part(standard(x, middle, spread), batch.column("half").to_numpy())
                    total = here if total is None else total + here
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

        sums = rows.mapInArrow(scan, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
        return sums.toPandas().sort_values("at")["v"].to_numpy()

    return gather


def fit(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from `measured` (doc_id, x: statistics) and `labels` (doc_id, quality); of the labels only the positives are used.

    All rows of `measured` are the unlabelled side, copies as often as they stand there. The
    bounded sample of the positives draws by the hash of doc_id; rows of equal id count once in it.
    Without two positives nothing is learned and every score is a half.
    """
    positive = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    trusted = measured.join(positive, "doc_id", "left_semi").select("doc_id", "x")
    share = min(1.0, sample / max(trusted.agg(F.approx_count_distinct("doc_id")).first()[0], 1))
    drawn = trusted.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    got = drawn.groupBy("doc_id").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")
    if len(got) < 2:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(STATISTICS), 0.0, 0.5)
    columns = [F.get("x", F.lit(i)) for i in range(STATISTICS)]
    moments = np.array(measured.agg(*map(F.avg, columns), *map(F.stddev_pop, columns)).first(), dtype=float)
    middle, spread = moments[:STATISTICS], moments[STATISTICS:] + 1e-6
    p = standard(np.array(got["x"].tolist()), middle, spread)[np.random.default_rng(7).permutation(len(got))]
    gather = gatherer(measured, middle, spread)
    prior = estimate_prior(p, gather)
    (w,) = minimise([p], gather, [None], prior, [np.zeros(STATISTICS + 1)])
    return Model(middle, spread, w[:-1], float(w[-1]), prior)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without `text`, with score (0 to 1) and predicted (1 from `threshold` on).

    Whole texts, no shuffle; null counts as empty, and the empty text has the score of its
    statistics like any other. The names score and predicted must be free.
    """
    name = free_name(docs, "x")
    return scored(measure(docs, name), name, model, threshold)


def scored(measured: DataFrame, name: str, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """`measured` without its statistics `name`, with score and predicted."""
    rows = measured.withColumn("score", model.score(name)).drop(name)
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Every row of `docs` (doc_id, text) as doc_id, held_out, score, predicted.

    Learns from rows whose id's crc32 is not 0 modulo 5. The texts are read once; fit and
    scores go on from the written statistics. An empty table gives no rows.
    """
    measured = cut(measure(docs.select(docs["doc_id"], (remainder(docs, 5) == 0).alias("held_out"), docs["text"]), "x"))
    model = fit(measured.where(~F.col("held_out")), labels.where(remainder(labels, 5) != 0), sample)
    return scored(measured, "x", model)
