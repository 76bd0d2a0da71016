"""Training and evaluating level classifiers with Spark ML.

The data stay distributed throughout. What reaches the driver is the model (vocabulary
and weights, both sized by a parameter) and one row of metrics per class.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    CountVectorizer,
    IndexToString,
    NGram,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrade.functions.features import TEXT_FEATURES, with_bilingual_ratios, with_text_features
from lexigrade.levels import LEVELS
from lexigrade.operators import metrics
from lexigrade.operators.numeric import fit_scaling
from lexigrade.operators.sampling import (
    keep_frequent_classes,
    require_classes,
    stratified_split,
)
from lexigrade.operators.tfidf import fit_tfidf
from lexigrade.operators.word_model import feature_names, word_distribution_features
from lexigrade.session import ensure_checkpoint_dir, materialise
from lexigrade.sources import corpora

# The solver's iteration cap and stopping tolerance.
MAX_ITERATIONS = 2000
TOLERANCE = 1e-4


@dataclass
class Trained:
    """A fitted model, its counted held-out predictions (label, pred, n), the counted classes
    (label, n) and the training settings. Both counts are written: at most classes² rows."""

    model: PipelineModel
    predictions: DataFrame
    labelled: DataFrame
    settings: dict[str, Any] = field(default_factory=dict)

    def report(self) -> DataFrame:
        return metrics.class_report(self.predictions)

    def metric_rows(self) -> DataFrame:
        """(metric, label, pred, value): accuracy, macro F1, report, confusion, classes."""
        text = F.lit(None).cast("string")

        def rows(df: DataFrame, metric: str, value: str, label=text, pred=text) -> DataFrame:
            return df.select(
                F.lit(metric).alias("metric"),
                label.alias("label"),
                pred.alias("pred"),
                F.col(value).cast("double").alias("value"),
            )

        label, pred = F.col("label"), F.col("pred")
        report = self.report()
        parts = [
            rows(metrics.accuracy(self.predictions), "accuracy", "accuracy"),
            rows(metrics.macro_f1(self.predictions), "macro_f1", "macro_f1"),
            *[rows(report, m, m, label) for m in ("precision", "recall", "f1", "support")],
            rows(metrics.confusion(self.predictions, self.labelled), "confusion", "n", label, pred),
            rows(metrics.class_distribution(self.labelled), "class_share", "share", label),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def write(self, folder: str) -> None:
        """Model, metrics and settings under one folder."""
        self.model.write().overwrite().save(f"{folder}/model")
        settings = F.lit(json.dumps(self.settings, ensure_ascii=False, sort_keys=True))
        corpora.write_json(
            self.metric_rows().withColumn("settings", settings), f"{folder}/metrics"
        )


def load_model(folder: str) -> PipelineModel:
    return PipelineModel.load(f"{folder}/model")


def feature_frame(
    corpus: DataFrame,
    id_col: str,
    *,
    english: bool = True,
    russian: bool = True,
    word_probs: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """The corpus with its numeric features, and their names.

    Word-model features are joined on the id, so rows cannot drift apart.
    """
    frame, names = corpus, []
    if english:
        frame = with_text_features(frame, corpora.TEXT_EN, "en_")
        names += [f"en_{n}" for n in TEXT_FEATURES]
    if russian:
        frame = with_text_features(frame, corpora.TEXT_RU, "ru_")
        names += [f"ru_{n}" for n in TEXT_FEATURES]
    if word_probs is not None:
        by_word = word_distribution_features(corpus, word_probs, id_col, corpora.TEXT_RU)
        frame = frame.join(by_word, id_col, "left")
        names += feature_names()
    if english and russian:
        frame = with_bilingual_ratios(frame)
        names += ["aligned_token_ratio", "aligned_sentence_ratio", "syllable_ratio"]
    return frame, names


def _number(value: float) -> str:
    """A double as SQL reads it back, whatever its size."""
    return f"CAST('{value!r}' AS double)"


def _scaling_stage(train: DataFrame, numeric: list[str]) -> tuple[SQLTransformer, list[str]]:
    """Median filling and standard scaling with the constants of the training rows."""
    fitted = fit_scaling(train, numeric)
    names = [f"_scaled_{i}" for i in range(len(numeric))]
    cells = []
    for name, column in zip(names, numeric):
        median, mean, scale = map(_number, fitted[column])
        value = "CAST(`{}` AS double)".format(column.replace("`", "``"))
        cells.append(
            f"(coalesce(nanvl({value}, CAST(NULL AS double)), {median}) - {mean}) / {scale} AS {name}"
        )
    return SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__"), names


def _without_summary(model: LogisticRegressionModel, df: DataFrame) -> LogisticRegressionModel:
    """The fitted regression written and read back, which drops its training summary.

    The summary holds the session, and a session that has observed a query cannot be
    shipped to tasks, so the model as fitted would fail there.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/regression-{uuid.uuid4().hex}"
    model.write().save(path)
    return LogisticRegressionModel.load(path)


def fit_classifier(
    train: DataFrame,
    text_cols: list[str],
    numeric_cols: list[str],
    label_col: str = "label",
    *,
    max_features: int,
    ngram_max: int,
    max_iterations: int = MAX_ITERATIONS,
) -> PipelineModel:
    """TF-IDF per text column and scaled numbers into an L2 multinomial regression.

    The penalty of 1/n on the mean loss is the usual C = 1 on the summed loss.
    """
    stages: list[Any] = []
    inputs: list[str] = []
    for text_col in text_cols:
        stages.append(fit_tfidf(train, text_col, f"tfidf_{text_col}", max_features, ngram_max))
        inputs.append(f"tfidf_{text_col}")
    if numeric_cols:
        scaler, names = _scaling_stage(train, numeric_cols)
        stages.append(scaler)
        inputs += names
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    indexer = StringIndexer(
        inputCol=label_col, outputCol="_label_id", stringOrderType="alphabetAsc"
    ).fit(train)
    ready = train
    for stage in stages:
        ready = stage.transform(ready)
    ready = indexer.transform(ready).select("features", "_label_id")
    ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        regression = LogisticRegression(
            family="multinomial",
            featuresCol="features",
            labelCol="_label_id",
            regParam=1.0 / ready.count(),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=max_iterations,
            tol=TOLERANCE,
        ).fit(ready)
        regression = _without_summary(regression, ready)
    finally:
        ready.unpersist()
    names = IndexToString(inputCol="prediction", outputCol="pred", labels=indexer.labels)
    return PipelineModel([*stages, regression, names])


def class_names(model: PipelineModel) -> list[str]:
    """Classes of a fitted model, in the order of its probabilities."""
    return next(s for s in reversed(model.stages) if isinstance(s, IndexToString)).getLabels()


def level_probabilities(model: PipelineModel, rows: DataFrame, key: str) -> DataFrame:
    """(key, probs): probabilities in the order of the scale; untrained levels get 0."""
    known = class_names(model)
    given = vector_to_array("probability")
    ordered = F.array(
        *[
            F.get(given, F.lit(known.index(level))) if level in known else F.lit(0.0)
            for level in LEVELS
        ]
    )
    return model.transform(rows).select(key, ordered.alias("probs"))


def _train(
    frame: DataFrame,
    id_col: str,
    label_col: str,
    text_cols: list[str],
    numeric_cols: list[str],
    settings: dict[str, Any],
) -> Trained:
    labelled = frame.withColumn(label_col, F.col(label_col).cast("string"))
    # The split sees ids and labels only; the features join it and are written once.
    split = stratified_split(
        labelled.select(id_col, label_col),
        id_col, label_col, test_size=settings["test_size"], seed=settings["seed"],
    )
    rows = materialise(labelled.join(split.select(id_col, "is_test"), id_col))
    model = fit_classifier(
        rows.where(~F.col("is_test")),
        text_cols,
        numeric_cols,
        label_col,
        max_features=settings["max_features"],
        ngram_max=settings["ngram_max"],
        max_iterations=settings["max_iterations"],
    )
    predicted = model.transform(rows.where("is_test")).select(F.col(label_col).alias("label"), "pred")
    return Trained(
        model,
        materialise(metrics.counted(predicted)),
        materialise(metrics.counted(rows.select(F.col(label_col).alias("label")))),
        settings,
    )


def train_text_classifier(
    raw: DataFrame,
    id_col: str,
    *,
    word_probs: DataFrame | None = None,
    english: bool = False,
    russian: bool = True,
    test_size: float = 0.2,
    seed: int = 42,
    max_features: int = 5000,
    ngram_max: int = 2,
    max_iterations: int = MAX_ITERATIONS,
) -> Trained:
    """Level of a text from TF-IDF, text statistics and, with `word_probs`, word levels."""
    columns = corpora.text_columns(english, russian)
    corpus = corpora.text_corpus(raw, english=english, russian=russian)
    frame, numeric = feature_frame(
        corpus, id_col, english=english, russian=russian, word_probs=word_probs
    )
    settings = {
        "english": english,
        "russian": russian,
        "word_distribution": word_probs is not None,
        "test_size": test_size,
        "seed": seed,
        "max_features": max_features,
        "ngram_max": ngram_max,
        "max_iterations": max_iterations,
    }
    return _train(frame, id_col, corpora.LABEL, columns, numeric, settings)


def train_sentence_model(raw: DataFrame, id_col: str, **options: Any) -> Trained:
    """Text classifier on the Russian side without word levels: (text) → probabilities."""
    return train_text_classifier(raw, id_col, english=False, word_probs=None, **options)


def train_tabular_model(
    raw: DataFrame,
    id_col: str,
    *,
    test_size: float = 0.2,
    seed: int = 42,
    max_features: int = 3000,
    ngram_max: int = 2,
    max_iterations: int = MAX_ITERATIONS,
) -> Trained:
    """Level of a sentence pair from TF-IDF of both sides and the seven numbers."""
    frame = corpora.tabular_corpus(raw)
    settings = {
        "test_size": test_size,
        "seed": seed,
        "max_features": max_features,
        "ngram_max": ngram_max,
        "max_iterations": max_iterations,
    }
    numeric = [c for c in corpora.TABULAR_NUMERIC if c in frame.columns]
    return _train(
        frame, id_col, corpora.TABULAR_TARGET, list(corpora.TABULAR_TEXT), numeric, settings
    )


# --- word model ----------------------------------------------------------------------


def _letter_stages(max_features: int, ngram_max: int) -> list[Any]:
    """Letter n-grams of `text`, with the word's ends marked."""
    grams = [f"_letters{n}" for n in range(2, ngram_max + 1)]
    return [
        SQLTransformer(
            statement="SELECT *, split(concat('^', lower(text), '$'), '') AS _letters "
            "FROM __THIS__"
        ),
        *[
            NGram(n=n, inputCol="_letters", outputCol=g)
            for n, g in zip(range(2, ngram_max + 1), grams)
        ],
        SQLTransformer(
            statement=f"SELECT *, concat({', '.join(['_letters', *grams])}) AS _grams "
            "FROM __THIS__"
        ),
        CountVectorizer(inputCol="_grams", outputCol="features", vocabSize=max_features),
    ]


def train_word_model(
    labels: DataFrame,
    id_col: str,
    *,
    test_size: float = 0.2,
    seed: int = 42,
    max_features: int = 5000,
    ngram_max: int = 3,
    strengths: tuple[float, ...] = (1.0, 0.1),
    max_iterations: int = 100,
) -> Trained:
    """Level of a single word from its letter n-grams; `labels` is (id, text, label).

    Classes with one row are left out. Equal (text, label) rows train as one weighted
    row, which also removes the weight of very frequent words from the data volume. Of
    the penalties tried, the one with the best macro F1 on the held-out rows is kept.
    """
    # Written once: every step below reads the labels, which are costly to make.
    usable = keep_frequent_classes(materialise(labels.select(id_col, "text", "label")))
    require_classes(usable)
    split = stratified_split(usable, id_col, test_size=test_size, seed=seed)
    split = materialise(split.select("text", "label", "is_test"))
    train = (
        split.where(~F.col("is_test"))
        .groupBy("text", "label")
        .agg(F.count(F.lit(1)).cast("double").alias("_weight"))
    )
    indexer: StringIndexerModel = StringIndexer(
        inputCol="label", outputCol="_label_id", stringOrderType="alphabetAsc"
    ).fit(train)
    stages: list[Any] = []
    ready = train
    for stage in _letter_stages(max_features, ngram_max):
        fitted = stage.fit(ready) if isinstance(stage, CountVectorizer) else stage
        stages.append(fitted)
        ready = fitted.transform(ready)
    ready = indexer.transform(ready).select("features", "_label_id", "_weight")
    ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
    total = ready.agg(F.sum("_weight")).first()[0]
    names = IndexToString(inputCol="prediction", outputCol="pred", labels=indexer.labels)
    best = None
    for strength in strengths:
        regression = LogisticRegression(
            family="multinomial",
            labelCol="_label_id",
            weightCol="_weight",
            regParam=strength / total,
            standardization=False,
            maxIter=max_iterations,
            tol=TOLERANCE,
        ).fit(ready)
        regression = _without_summary(regression, ready)
        model = PipelineModel([*stages, regression, names])
        predictions = materialise(
            metrics.counted(model.transform(split.where("is_test")).select("label", "pred"))
        )
        score = metrics.macro_f1(predictions).first()["macro_f1"] or 0.0
        if best is None or score > best[0]:
            best = (score, strength, model, predictions)
    ready.unpersist()
    _, strength, model, predictions = best
    settings = {
        "test_size": test_size,
        "seed": seed,
        "max_features": max_features,
        "ngram_max": ngram_max,
        "strength": strength,
        "max_iterations": max_iterations,
    }
    classes = materialise(metrics.counted(split.select("label")))
    return Trained(model, predictions, classes, settings)


def word_scorer(trained: Trained):
    """The trained model as the (word) → (word, probs) function of `score_words`."""

    def score(words: DataFrame) -> DataFrame:
        rows = words.select("word", F.col("word").alias("text"))
        return level_probabilities(trained.model, rows, "word")

    return score
