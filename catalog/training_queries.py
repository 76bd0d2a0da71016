"""Silver labels, class handling, features, metrics and the trained models."""

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import sql as q
from catalog.alignment_queries import phrased
from catalog.registry import r6, register
from catalog.text_queries import bilingual_sql
from lexigrade.functions import text as t
from lexigrade.functions.features import TEXT_FEATURES
from lexigrade.levels import LEVELS
from lexigrade.operators import metrics, numeric, sampling, softmax, tfidf
from lexigrade.operators.lexicon import build_lexicon
from lexigrade.operators.word_model import (
    distinct_words,
    feature_names,
    score_words,
    word_distribution_features as word_features,
)
from lexigrade.plans import epochs, silver, training
from lexigrade.session import ensure_checkpoint_dir, materialise
from lexigrade.sources import corpora
from lexigrade.streaming import conversations

# --- silver labels -------------------------------------------------------------------


def _silver(spark, sf_dir, sentences=True):
    return silver.silver_labels(
        fx.pairs(spark, sf_dir).select("pair_id", "kaz", "rus"),
        build_lexicon(fx.lexicon_raw(spark, sf_dir)),
        fx.lemmas(spark, sf_dir),
        fx.encoder(spark, sf_dir),
        sentences=sentences,
    )


@register(
    "silver_labels",
    q.query(
        "silver",
        """SELECT pair_id, russian_index, kaz_item, rus_item, cefr, md5(kaz_sent) AS kaz_sent,
          md5(rus_sent) AS rus_sent FROM silver""",
    ),
)
def silver_labels(spark, sf_dir):
    return _silver(spark, sf_dir).select(
        "pair_id", "russian_index", "kaz_item", "rus_item", "cefr",
        F.md5(F.col("kaz_sent").cast("binary")).alias("kaz_sent"),
        F.md5(F.col("rus_sent").cast("binary")).alias("rus_sent"),
    )


@register(
    "silver_skipped",
    q.query(
        "lengths phrases",
        """SELECT count(*) AS pairs, count(*) FILTER (too_long) AS too_long,
          count(*) FILTER (p.pair_id IS NULL) AS skipped
        FROM lengths l LEFT JOIN (SELECT DISTINCT pair_id FROM phrases) p
          ON p.pair_id = l.pair_id""",
    ),
)
def silver_skipped(spark, sf_dir):
    return silver.skipped_pairs(phrased(spark, sf_dir))


def _clean_labels(spark, sf_dir):
    cleaned = corpora.word_labels(_silver(spark, sf_dir, sentences=False))
    key = F.concat_ws(":", "pair_id", "russian_index", "span_start")
    return cleaned.select(key.alias("row_id"), "text", "label")


CLEAN = """SELECT concat_ws(':', pair_id, russian_index, start) AS row_id, text, label
  FROM clean_labels"""


@register("label_clean", q.query("clean_labels", CLEAN))
def label_clean(spark, sf_dir):
    return _clean_labels(spark, sf_dir)


@register(
    "class_filter",
    q.query(
        "clean_labels",
        f"""SELECT * FROM ({CLEAN}) WHERE label IN
        (SELECT label FROM clean_labels GROUP BY label HAVING count(*) >= 1000)""",
    ),
)
def class_filter(spark, sf_dir):
    """With a minimum of 1,000 rows per class, so that classes do drop out."""
    return sampling.keep_frequent_classes(_clean_labels(spark, sf_dir), 1000)


# --- split and classes ---------------------------------------------------------------


def _corpus(spark, sf_dir):
    return corpora.text_corpus(fx.text_corpus(spark, sf_dir))


SPLIT_SQL = """SELECT doc_id, label, row_number() OVER (PARTITION BY label
    ORDER BY md5('42:' || doc_id::VARCHAR), doc_id)
    <= round_even(0.2::DOUBLE * count(*) OVER (PARTITION BY label), 0) AS is_test
  FROM text_corpus"""


@register("stratified_split", q.query("text_corpus", SPLIT_SQL))
def stratified_split(spark, sf_dir):
    corpus = _corpus(spark, sf_dir).select("doc_id", "label")
    return sampling.stratified_split(corpus, "doc_id")


EXACT_SPLIT_SQL = """SELECT doc_id, t.label, row_number() OVER (PARTITION BY t.label
    ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) <= quota AS is_test
  FROM text_corpus t JOIN (
    SELECT label, base + (row_number() OVER (ORDER BY rest DESC, label) <= wanted - sum(base) OVER ())::INT AS quota
    FROM (SELECT label, n * wanted // total AS base, n * wanted % total AS rest, wanted
          FROM (SELECT label, n, total, ceil(round(0.15::DOUBLE * total, 9))::BIGINT AS wanted
                FROM (SELECT label, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM text_corpus GROUP BY label)))) k
  ON k.label = t.label"""


@register("stratified_split_exact", q.query("text_corpus", EXACT_SPLIT_SQL))
def stratified_split_exact(spark, sf_dir):
    """15 % of all rows, to the row: the classes' quotas by largest remainders."""
    corpus = _corpus(spark, sf_dir).select("doc_id", "label")
    return sampling.stratified_split(corpus, "doc_id", test_size=0.15, exact_total=True)


@register(
    "label_encoding",
    q.query(
        "text_corpus",
        """SELECT label, (dense_rank() OVER (ORDER BY label)) - 1 AS label_id
        FROM (SELECT DISTINCT label FROM text_corpus)""",
    ),
)
def label_encoding(spark, sf_dir):
    return sampling.encode_labels(_corpus(spark, sf_dir))


@register(
    "class_distribution",
    q.query(
        "text_corpus",
        """SELECT label, round(count(*)::DOUBLE / (SELECT count(*) FROM text_corpus), 6) AS share
        FROM text_corpus GROUP BY label""",
    ),
)
def class_distribution(spark, sf_dir):
    shares = metrics.class_distribution(_corpus(spark, sf_dir))
    return shares.select("label", r6("share").alias("share"))


# --- metrics -------------------------------------------------------------------------


@register(
    "accuracy",
    q.query(
        "quality_predictions",
        "SELECT round(avg((label = pred)::INT), 6) AS accuracy FROM quality_predictions",
    ),
)
def accuracy(spark, sf_dir):
    return metrics.accuracy(fx.quality_predictions(spark, sf_dir)).select(
        r6("accuracy").alias("accuracy")
    )


_AVERAGES = {
    "macro avg": "avg({})",
    "weighted avg": "sum({} * support) / sum(support)",
}


def _report_sql() -> str:
    names = ("precision", "recall", "f1")
    parts = [
        "SELECT label, support, "
        + ", ".join(f"round({n}, 6) AS {n}" for n in names)
        + " FROM class_scores"
    ]
    for label, form in _AVERAGES.items():
        cells = ", ".join(f"round({form.format(n)}, 6)" for n in names)
        parts.append(f"SELECT '{label}', sum(support)::BIGINT, {cells} FROM class_scores")
    return q.query("class_scores", " UNION ALL ".join(parts))


@register("class_report", _report_sql())
def class_report(spark, sf_dir):
    report = metrics.class_report(fx.level_predictions(spark, sf_dir))
    return report.select(
        "label", "support", *[r6(n).alias(n) for n in ("precision", "recall", "f1")]
    )


@register(
    "confusion",
    q.query(
        "level_predictions",
        """SELECT a.label, b.label AS pred, count(p.doc_id) AS n
        FROM (SELECT DISTINCT label FROM level_predictions) a
        JOIN (SELECT DISTINCT label FROM level_predictions) b ON true
        LEFT JOIN level_predictions p ON p.label = a.label AND p.pred = b.label
        GROUP BY a.label, b.label""",
    ),
)
def confusion(spark, sf_dir):
    return metrics.confusion(fx.level_predictions(spark, sf_dir))


@register(
    "macro_f1",
    q.query("class_scores", "SELECT round(avg(f1), 6) AS macro_f1 FROM class_scores"),
)
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(fx.level_predictions(spark, sf_dir)).select(
        r6("macro_f1").alias("macro_f1")
    )


# --- features ------------------------------------------------------------------------

_TERMS = f"""SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1]))) AS term
  FROM (SELECT doc_id, {q.find_all('lower(text_ru)', q.TERM)} AS w FROM text_corpus)"""
_VOCABULARY = f"""SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM ({_TERMS})
  GROUP BY term ORDER BY tf DESC, term LIMIT 500"""


@register("vocabulary_topk", q.query("text_corpus", _VOCABULARY))
def vocabulary_topk(spark, sf_dir):
    return tfidf.vocabulary(_corpus(spark, sf_dir), "text_ru", 500, 2)


@register(
    "tfidf",
    q.query(
        "text_corpus",
        f"""SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight
        FROM (SELECT t.doc_id, t.term, count(*) * (ln((1 + (SELECT count(*) FROM text_corpus))::DOUBLE
                / (1 + any_value(v.df))) + 1) AS x
              FROM ({_TERMS}) t JOIN ({_VOCABULARY}) v ON v.term = t.term
              GROUP BY t.doc_id, t.term)""",
    ),
)
def tfidf_weights(spark, sf_dir):
    cells = tfidf.tfidf_cells(_corpus(spark, sf_dir), "doc_id", "text_ru", 500, 2)
    return cells.select("doc_id", "term", r6("weight").alias("weight"))


_MEDIANS = " UNION ALL ".join(
    f"SELECT '{n}' AS name, round(median({n}), 6) AS median FROM tabular"
    for n in corpora.TABULAR_NUMERIC
)


@register("median_impute", q.query("tabular", _MEDIANS))
def median_impute(spark, sf_dir):
    corpus = corpora.tabular_corpus(fx.tabular_raw(spark, sf_dir))
    medians = numeric.exact_medians(corpus, list(corpora.TABULAR_NUMERIC))
    return medians.select("name", r6("median").alias("median"))


_FILLED = ", ".join(
    f"coalesce({n}, (SELECT median({n}) FROM tabular)) AS {n}" for n in corpora.TABULAR_NUMERIC
)
_SCALED = ", ".join(
    f"""round(({n} - (SELECT avg({n}) FROM filled)) / (SELECT CASE WHEN stddev_pop({n}) = 0
    THEN 1 ELSE stddev_pop({n}) END FROM filled), 5) AS {n}"""
    for n in corpora.TABULAR_NUMERIC
)


@register(
    "standard_scale",
    q.query("tabular", f"SELECT pair_id, {_SCALED} FROM filled").replace(
        "\nSELECT", f",\nfilled AS (SELECT pair_id, {_FILLED} FROM tabular)\nSELECT", 1
    ),
)
def standard_scale(spark, sf_dir):
    corpus = corpora.tabular_corpus(fx.tabular_raw(spark, sf_dir))
    fitted = numeric.fit_scaling(corpus, list(corpora.TABULAR_NUMERIC))
    return corpus.select(
        "pair_id", *[F.round(numeric.scaled(n, *fitted[n]), 5).alias(n) for n in fitted]
    )


_WORD_FEATURES = f"""SELECT d.doc_id, {", ".join(
    f"{q.ratio(f'p{i}', 'n')} AS word_cefr_prob_{lv}" for i, lv in enumerate(LEVELS))}, {", ".join(
    f"{q.ratio(f't{i}', 'n')} AS word_cefr_ratio_{lv}" for i, lv in enumerate(LEVELS))},
    coalesce(n, 0)::DOUBLE AS word_cefr_token_count
  FROM text_corpus d LEFT JOIN (SELECT doc_id, count(*) AS n, {", ".join(
    f"sum(p[{i + 1}]) AS p{i}" for i in range(6))}, {", ".join(
    f"count(*) FILTER (top = '{lv}') AS t{i}" for i, lv in enumerate(LEVELS))}
  FROM (SELECT doc_id, p, {q.top_level('p')} AS top FROM (
    SELECT doc_id, w FROM (SELECT doc_id, unnest({q.words('text_ru')}) AS w FROM text_corpus)) x
    JOIN (SELECT w, {q.digest_probs('w')} AS p FROM (
      SELECT DISTINCT unnest({q.words('text_ru')}) AS w FROM text_corpus)) y ON y.w = x.w)
  GROUP BY doc_id) f ON f.doc_id = d.doc_id"""
_WORD_NAMES = ", ".join(f"round({n}, 6) AS {n}" for n in feature_names())


def _corpus_word_probs(corpus):
    return score_words(distinct_words(corpus, "text_ru"), fx.digest_word_model)


@register(
    "word_distribution_features",
    q.query("text_corpus", f"SELECT doc_id, {_WORD_NAMES} FROM ({_WORD_FEATURES})"),
)
def word_distribution_features(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    rows = word_features(corpus, _corpus_word_probs(corpus), "doc_id", "text_ru")
    return rows.select("doc_id", *[r6(n).alias(n) for n in feature_names()])


_FRAME = [
    *[f"{p}_{n}" for p in ("en", "ru") for n in TEXT_FEATURES],
    *feature_names(),
    "aligned_token_ratio",
    "aligned_sentence_ratio",
    "syllable_ratio",
]


@register(
    "feature_frame",
    f"""SELECT b.doc_id, b.label, {", ".join(f"round({n}, 6) AS {n}" for n in _FRAME)}
    FROM ({bilingual_sql("*").replace("e.*,", "e.*, c.label,").replace(
        ") r ON r.doc_id = e.doc_id", ") r ON r.doc_id = e.doc_id JOIN text_corpus c ON c.doc_id = e.doc_id")}) b
    JOIN ({q.query("text_corpus", _WORD_FEATURES)}) w ON w.doc_id = b.doc_id""",
)
def feature_frame(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    frame, names = training.feature_frame(
        corpus, "doc_id", word_probs=_corpus_word_probs(corpus)
    )
    return frame.select(
        "doc_id", "label", *[r6(F.col(n).cast("double")).alias(n) for n in names]
    )


# --- trained models: what is known about any fit --------------------------------------


def _known_sql(needs: str, split: str) -> str:
    return q.query(
        needs,
        f"""SELECT 'support' AS metric, label, count(*)::DOUBLE AS value FROM ({split}) WHERE is_test GROUP BY label
        UNION ALL SELECT 'confusion_total', label, count(*) FILTER (is_test)::DOUBLE FROM ({split}) GROUP BY label
        UNION ALL SELECT 'class_share', label,
          round(count(*)::DOUBLE / (SELECT count(*) FROM ({split})), 6) FROM ({split}) GROUP BY label
        UNION ALL SELECT 'out_of_range', NULL, 0::DOUBLE""",
    )


def _known(trained):
    """Held-out support, row totals of the confusion matrix and class shares, which SQL can
    count, and how many of the scores lie outside 0 to 1."""
    rows = trained.metric_rows()
    score = F.col("metric").isin("accuracy", "macro_f1", "precision", "recall", "f1")
    averages = F.coalesce(F.col("label"), F.lit("")).endswith(" avg")
    counted = rows.where((F.col("metric") == "support") & ~averages & (F.col("value") > 0))
    shares = rows.where("metric = 'class_share'").withColumn("value", r6("value"))
    totals = rows.where("metric = 'confusion'").groupBy("label").agg(F.sum("value").alias("value"))
    outside = rows.agg(F.count_if(score & ~F.col("value").between(0, 1)).cast("double").alias("value"))
    return (
        counted.select("metric", "label", "value")
        .unionByName(totals.select(F.lit("confusion_total").alias("metric"), "label", "value"))
        .unionByName(shares.select("metric", "label", "value"))
        .unionByName(
            outside.select(F.lit("out_of_range").alias("metric"), F.lit(None).cast("string").alias("label"), "value")
        )
    )


def _checked_probs(rows, key):
    """Per key: the trained levels (those with any probability), the sum, and whether all lie in 0 to 1."""
    named = F.arrays_zip("probs", F.array(*[F.lit(level) for level in LEVELS]).alias("level"))
    return rows.select(
        key,
        F.size("probs").alias("n_probs"),
        F.array_join(F.transform(F.filter(named, lambda x: x["probs"] > 0), lambda x: x["level"]), ",").alias("levels"),
        r6(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)).alias("total"),
        F.forall("probs", lambda x: x.between(0, 1)).alias("in_range"),
    )


def _probs_sql(key: str, source: str, labels: str) -> str:
    return f"""SELECT {key}, 6 AS n_probs, levels, 1.0::DOUBLE AS total, true AS in_range
    FROM ({source}), (SELECT string_agg(label, ',' ORDER BY label) AS levels FROM ({labels}))"""


@register("train_text", _known_sql("text_corpus", SPLIT_SQL))
def train_text(spark, sf_dir):
    raw = fx.text_corpus(spark, sf_dir)
    probs = _corpus_word_probs(corpora.text_corpus(raw))
    return _known(training.train_text_classifier(raw, "doc_id", word_probs=probs))


TABULAR_SPLIT_SQL = SPLIT_SQL.replace("doc_id", "pair_id").replace(
    "FROM text_corpus", "FROM (SELECT pair_id, predicted_cefr AS label FROM tabular)"
)


@register("train_tabular", _known_sql("tabular", TABULAR_SPLIT_SQL))
def train_tabular(spark, sf_dir):
    raw = fx.tabular_raw(spark, sf_dir)
    return _known(training.train_tabular_model(raw, "pair_id"))


@register(
    "train_word",
    q.query(
        "clean_labels rus_tokens",
        _probs_sql(
            "word",
            "SELECT DISTINCT token AS word FROM rus_tokens",
            "SELECT label FROM clean_labels GROUP BY label HAVING count(*) >= 2",
        ),
    ),
)
def train_word(spark, sf_dir):
    """The word model, applied to every distinct Russian word."""
    trained = training.train_word_model(_clean_labels(spark, sf_dir), "row_id")
    words = fx.pairs(spark, sf_dir).select(F.explode(t.words(F.col("rus"))).alias("word"))
    return _checked_probs(score_words(words, training.word_scorer(trained)), "word")


@register(
    "train_sentence",
    q.query(
        "text_corpus pairs",
        _probs_sql("pair_id", "SELECT pair_id FROM pairs", "SELECT DISTINCT label FROM text_corpus"),
    ),
)
def train_sentence(spark, sf_dir):
    """The sentence model, trained on documents, applied to the Russian sides."""
    trained = training.train_sentence_model(fx.text_corpus(spark, sf_dir), "doc_id")
    sides = fx.pairs(spark, sf_dir).select(
        "pair_id", F.lit("").alias("text_en"), F.col("rus").alias("text_ru")
    )
    frame, _ = training.feature_frame(sides, "pair_id", english=False)
    return _checked_probs(training.level_probabilities(trained.model, frame, "pair_id"), "pair_id")


@register(
    "train_word_epochs",
    q.query(
        "clean_labels rus_tokens",
        _probs_sql(
            "word",
            "SELECT DISTINCT token AS word FROM rus_tokens",
            "SELECT label FROM clean_labels GROUP BY label HAVING count(*) >= 2",
        ),
    ),
)
def train_word_epochs(spark, sf_dir):
    """The word model of the best of two epochs, applied batch by batch to every distinct Russian word."""
    model, _ = epochs.train_word_epochs(
        _clean_labels(spark, sf_dir), "row_id", epochs=2, batches=4, max_features=1000
    )
    words = fx.pairs(spark, sf_dir).select(F.explode(t.words(F.col("rus"))).alias("word"))
    return _checked_probs(score_words(words, softmax.batch_scorer(spark, model)), "word")


@register(
    "saved_word_model",
    q.query(
        "rus_tokens",
        """SELECT count(DISTINCT token) AS words, 0::BIGINT AS differing, 0::BIGINT AS empty,
          (SELECT count(*) FROM rus_tokens) AS tokens FROM rus_tokens""",
    ),
)
def saved_word_model(spark, sf_dir):
    """Written, read back, and scored both as a pipeline and by the batch hook: how many words differ."""
    trained = training.train_word_model(_clean_labels(spark, sf_dir), "row_id", strengths=(1.0,))
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/word-model-{uuid.uuid4().hex}"
    trained.write(folder)
    loaded = training.load_model(folder)
    plain = softmax.WordModel.of_pipeline(loaded)
    plain.save(spark, f"{folder}/plain")
    hook = softmax.batch_scorer(spark, softmax.WordModel.load(spark, f"{folder}/plain"))
    tokens = materialise(fx.pairs(spark, sf_dir).select(F.explode(t.words(F.col("rus"))).alias("word")))
    by_hook = score_words(tokens, hook)
    by_pipeline = score_words(tokens, training.word_scorer(replace(trained, model=loaded)))
    both = by_hook.withColumnRenamed("probs", "a").join(by_pipeline.withColumnRenamed("probs", "b"), "word")
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda m, x: F.greatest(m, x))
    compared = both.agg(F.count(F.lit(1)).alias("words"), F.count_if(gap > 1e-9).alias("differing"))
    # One row each.
    counts = softmax.unscorable(tokens).select(F.col("empty"), F.col("words").alias("tokens"), F.lit(1).alias("one"))
    return compared.withColumn("one", F.lit(1)).join(counts, "one").drop("one")


@register(
    "saved_metrics",
    q.query(
        "text_corpus",
        f"""SELECT label, count(*)::DOUBLE AS support, count(*)::DOUBLE AS confused, true AS equal
        FROM ({SPLIT_SQL}) WHERE is_test GROUP BY label""",
    ),
)
def saved_metrics(spark, sf_dir):
    """Metrics written as JSON and read back: each class's support, its row of the confusion matrix, and whether
    precision, recall and F1 equal those of the written confusion counts."""
    trained = training.train_text_classifier(fx.text_corpus(spark, sf_dir), "doc_id", max_features=300, max_iterations=20)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/text-model-{uuid.uuid4().hex}"
    trained.write(folder)
    read = materialise(spark.read.schema("metric string, label string, pred string, value double").json(f"{folder}/metrics"))
    cells = read.where("metric = 'confusion'")
    rows = cells.groupBy("label").agg(F.sum("value").alias("confused"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("value"))).alias("hit"))
    columns = cells.groupBy(F.col("pred").alias("label")).agg(F.sum("value").alias("given"))
    scores = read.where("metric IN ('precision', 'recall', 'f1', 'support')").groupBy("label").pivot("metric", ["precision", "recall", "f1", "support"]).agg(F.first("value"))
    joined = scores.join(rows, "label").join(columns, "label").where("support > 0")
    equal = (
        (F.abs(F.col("recall") - t.safe_ratio(F.col("hit"), F.col("confused"))) < 1e-9)
        & (F.abs(F.col("precision") - t.safe_ratio(F.col("hit"), F.col("given"))) < 1e-9)
        & (F.abs(F.col("f1") - t.safe_ratio(2 * F.col("hit"), F.col("given") + F.col("confused"))) < 1e-9)
    )
    return joined.select("label", "support", "confused", equal.alias("equal"))


# --- streams -------------------------------------------------------------------------


@register(
    "stream_conversation_levels",
    q.query(
        "turns lexicon",
        f"""SELECT conv_id, turns, words, {", ".join(f"n{i}" for i in range(6))},
          CASE WHEN known > 0 THEN {q.LEVEL_LIST}[round_even((0.0::DOUBLE + {" + ".join(f"{i}.0::DOUBLE * (n{i}::DOUBLE / known)" for i in range(6))}), 0)::INT + 1]
            ELSE 'Unknown' END AS level
        FROM (SELECT *, {" + ".join(f"n{i}" for i in range(6))} AS known FROM (
          SELECT t.conv_id, any_value(t.turns) AS turns, count(w.word) AS words, {", ".join(f"count(*) FILTER (level = '{lv}') AS n{i}" for i, lv in enumerate(LEVELS))}
          FROM (SELECT conv_id, count(DISTINCT turn) AS turns FROM turns GROUP BY conv_id) t
          LEFT JOIN (SELECT conv_id, lower(word) AS word FROM (SELECT conv_id, unnest({q.words('text')}) AS word FROM turns) WHERE {q.cyrillic('word')}) w
            ON w.conv_id = t.conv_id
          LEFT JOIN lexicon l ON l.word = w.word GROUP BY t.conv_id))""",
    ),
)
def stream_conversation_levels(spark, sf_dir):
    """The conversations read as a stream; a state per conversation, the last counts of each."""
    lexicon = conversations.hold_lexicon(build_lexicon(fx.lexicon_raw(spark, sf_dir)))
    given = fx.table(spark, sf_dir, "conversations")
    # A pattern, as a plain path may only name a folder here and the table may be one file.
    turns = spark.readStream.schema(given.schema).parquet(f"{sf_dir}/conversations.parque[t]").select(
        "conv_id", "turn", fx.transliterate(F.col("text")).alias("text"), F.timestamp_seconds(F.col("turn") + 86400).alias("time")
    )
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    counts = conversations.conversation_counts(turns, lexicon, watermark="30 days")
    conversations.run_available(counts, f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    written = spark.read.parquet(f"{folder}/counts")
    levels = [F.get("counts", F.lit(i)).alias(f"n{i}") for i in range(len(LEVELS))]
    return conversations.latest(written).select("conv_id", "turns", "words", *levels, "level")
