import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexigrade.llm import quality


def auc(score, label):
    low, high = np.sort(score[label == 0]), score[label == 1]
    return ((np.searchsorted(low, high, "left") + np.searchsorted(low, high, "right")) / 2 / len(low)).mean()


def test_statistics_of_a_text():
    got = quality.inputs(pa.array(["AB ab! ab\nx 1", None, "é"]))
    assert got.shape == (3, quality.STATISTICS)
    assert np.isfinite(got).all()
    capitals, digits, signs, plain, spaces, lines, size = got[0, :7]
    assert capitals**2 == pytest.approx(2 / 13) and digits**2 == pytest.approx(1 / 13) and signs**2 == pytest.approx(1 / 13)
    assert plain == 0 and spaces**2 == pytest.approx(4 / 13) and lines**2 == pytest.approx(1 / 13)
    assert size == pytest.approx(np.log1p(13))
    assert got[0, 7] == 1 and got[0, 8] == 0 and got[0, 9] == pytest.approx(0.2)


def ones(x):
    return np.append(x, np.ones((len(x), 1)), axis=1)


def over(x):
    """Sums over rows in memory."""
    return lambda part: part(x, np.arange(len(x)) % 2)


def test_prior_and_risk_on_two_gaussians():
    rng = np.random.default_rng(3)
    positive = ones(rng.normal(2, 1, (3000, 2)))
    unlabelled = ones(np.concatenate([rng.normal(2, 1, (2100, 2)), rng.normal(-2, 1, (900, 2))])[rng.permutation(3000)])
    prior = quality.estimate_prior(positive, over(unlabelled))
    assert prior == pytest.approx(0.7, abs=0.04)
    (w,) = quality.minimise([positive], over(unlabelled), [None], prior, [np.zeros(3)])
    test, label = ones(np.concatenate([rng.normal(2, 1, (500, 2)), rng.normal(-2, 1, (500, 2))])), np.repeat([1, 0], 500)
    assert ((quality.sigmoid(test @ w) > 0.5) == label).mean() > 0.97


def test_risk_is_least_where_nothing_holds_it():
    """Where the negative risk is above zero the gradient of the risk vanishes; it is taken here by plain differences."""
    rng = np.random.default_rng(5)
    positive = ones(rng.normal(1, 1, (500, 3)))
    unlabelled = ones(np.concatenate([rng.normal(1, 1, (300, 3)), rng.normal(-1, 1, (700, 3))]))
    (w,) = quality.minimise([positive], over(unlabelled), [None], 0.3, [np.zeros(4)])

    def risk(v):
        fp, fu = positive @ v, unlabelled @ v
        negative = np.logaddexp(0, fu).mean() - 0.3 * np.logaddexp(0, fp).mean()
        assert negative > 0
        return 0.3 * np.logaddexp(0, -fp).mean() + negative + quality.DECAY / 2 * (v[:-1] ** 2).sum()

    for i in range(4):
        step = np.eye(4)[i] * 1e-4
        assert abs(risk(w + step) - risk(w - step)) / 2e-4 < 1e-3


def test_negative_risk_stays_above_zero():
    rng = np.random.default_rng(4)
    positive, unlabelled = ones(rng.normal(size=(30, 200))), ones(rng.normal(size=(40, 200)))  # more inputs than rows
    (w,) = quality.minimise([positive], over(unlabelled), [None], 0.6, [np.zeros(201)])
    fp, fu = positive @ w, unlabelled @ w
    assert np.logaddexp(0, fu).mean() - 0.6 * np.logaddexp(0, fp).mean() >= 0
    assert 0.6 * np.logaddexp(0, -fp).mean() < 0.6 * np.log(2)


def test_sums_over_all_rows(spark):
    """What Spark gathers equals one sum in memory, in as many partitions as there are."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, quality.STATISTICS))
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "doc_id long, x array<double>").repartition(7)
    middle, spread, w = x.mean(axis=0), x.std(axis=0), rng.normal(size=quality.STATISTICS + 1)
    got = quality.gatherer(rows, middle, spread)(lambda part, half: np.append(quality.curvature(part, w), [half.sum(), (1 - half).sum()]))
    assert np.allclose(got[:-2], quality.curvature(quality.standard(x, middle, spread), w))
    assert got[-2:].sum() == 500 and got[-2:].min() > 150


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert auc(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.99
    assert (held["predicted"] == held["quality"]).mean() > 0.95


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, "a b"), (2, "a b"), (3, "x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kind", "2 as _h", "3 as score")
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0
