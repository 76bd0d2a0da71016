"""Text and word levels, word-model reports, ensembles."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import sql as q
from catalog.alignment_queries import phrased
from catalog.registry import r6, register
from lexigrade.functions import distributions as d
from lexigrade.functions import text as t
from lexigrade.levels import LEVELS
from lexigrade.operators import scoring
from lexigrade.operators.lexicon import build_lexicon
from lexigrade.operators.word_model import score_words, word_predictions
from lexigrade.plans import grading
from lexigrade.session import materialise

SHARES = [f"share_{level.lower()}" for level in LEVELS]
SHARES_SQL = ", ".join(f"round(dist[{i + 1}], 6) AS {n}" for i, n in enumerate(SHARES))


def _shares(column="distribution"):
    return [r6(F.get(column, F.lit(i))).alias(n) for i, n in enumerate(SHARES)]


def _pairs(spark, sf_dir):
    return fx.pairs(spark, sf_dir).select("pair_id", "kaz", "rus")


def _lexicon(spark, sf_dir):
    return build_lexicon(fx.lexicon_raw(spark, sf_dir))


def _graded_texts(spark, sf_dir):
    """Of texts whose own translation is missing where the role is not the user's: it is looked up."""
    return grading.grade_texts(
        _untranslated(spark, sf_dir),
        _lexicon(spark, sf_dir),
        fx.encoder(spark, sf_dir),
        translations=fx.translations(spark, sf_dir),
    )


def _untranslated(spark, sf_dir):
    """Every turn's text; only the user's turns bring a translation of their own. The table's
    answer is that of the smallest pair with the same text, in SQL as `translated`."""
    return fx.pairs(spark, sf_dir).select(
        "pair_id", "kaz", F.when(F.col("role") == "user", F.col("rus")).alias("rus")
    )


def _graded_phrases(spark, sf_dir):
    return grading.graded_phrases(phrased(spark, sf_dir), _lexicon(spark, sf_dir))


@register(
    "text_distribution",
    q.query("levels", f"SELECT pair_id, level AS average_level, {SHARES_SQL} FROM levels"),
)
def text_distribution(spark, sf_dir):
    graded = scoring.distribution_per(_graded_phrases(spark, sf_dir), ["pair_id"])
    return graded.select("pair_id", "average_level", *_shares())


@register(
    "text_level",
    q.query(
        "levels",
        f"""SELECT pair_id, too_long, level AS cefr_level,
          round(coalesce(dist[list_position({q.LEVEL_LIST}, level)], 0), 6) AS confidence,
          {SHARES_SQL} FROM levels""",
    ),
)
def text_level(spark, sf_dir):
    report = grading.text_levels(
        _pairs(spark, sf_dir), _lexicon(spark, sf_dir), fx.encoder(spark, sf_dir)
    )
    return report.select(
        "pair_id", "too_long", "cefr_level", r6("confidence").alias("confidence"), *_shares()
    )


@register(
    "text_report",
    q.query(
        "graded_tr lengths_tr translated",
        """SELECT l.pair_id, md5(any_value(t.rus)) AS rus, any_value(t.translation_used) AS translation_used,
          coalesce(count(g.pair_id), 0) AS phrases,
          md5(coalesce(string_agg(g.russian_index || ':' || g.phrase || '=' || g.token || '/'
            || g.level, '|' ORDER BY g.russian_index, g.start), '')) AS alignments
        FROM lengths_tr l JOIN translated t ON t.pair_id = l.pair_id
        LEFT JOIN graded_tr g ON g.pair_id = l.pair_id GROUP BY l.pair_id""",
    ),
)
def text_report(spark, sf_dir):
    """Each text with its phrases in text order, folded to a digest."""
    line = F.transform(
        "phrase_alignments",
        lambda p: F.concat(
            p["russian_index"].cast("string"), F.lit(":"), p["kazakh_phrase"], F.lit("="),
            p["russian_token"], F.lit("/"), p["level"],
        ),
    )
    return _graded_texts(spark, sf_dir).select(
        "pair_id",
        F.md5(F.col("rus").cast("binary")).alias("rus"),
        "translation_used",
        F.size("phrase_alignments").alias("phrases"),
        F.md5(F.array_join(line, "|").cast("binary")).alias("alignments"),
    )


@register(
    "word_alignments",
    q.query(
        "word_rows",
        """SELECT pair_id, kazakh_token, russian_token, kazakh_index, russian_index, level
        FROM word_rows""",
    ),
)
def word_alignments(spark, sf_dir):
    return scoring.word_alignments(_graded_phrases(spark, sf_dir)).drop("span_start")


CAPITALS = fx.CYRILLIC.upper()


def _capitals(column):
    """Capitals for the transliterated letters alone: they fold back without loss."""
    return F.translate(column, fx.CYRILLIC, CAPITALS)


@register(
    "word_level",
    q.query(
        "word_rows levels word_lists",
        f"""SELECT k.pair_id, k.word, a.kazakh_token, a.russian_token, a.kazakh_index,
          a.russian_index, a.level,
          CASE WHEN a.level IS NOT NULL
            THEN round(coalesce(v.dist[list_position({q.LEVEL_LIST}, a.level)], 0), 6) END
            AS confidence
        FROM (SELECT pair_id, unnest(list_distinct(list_transform(w, lambda x: translate(x, '{fx.CYRILLIC}', '{CAPITALS}')))) AS word FROM word_lists
              WHERE side = 'kaz') k
        JOIN levels v ON v.pair_id = k.pair_id
        LEFT JOIN (SELECT pair_id, lower(kazakh_token) AS target, unnest(arg_min(
              {{'kazakh_token': kazakh_token, 'russian_token': russian_token,
                'kazakh_index': kazakh_index, 'russian_index': russian_index, 'level': level}},
              [russian_index, start, kazakh_index]))
            FROM word_rows GROUP BY pair_id, lower(kazakh_token)) a
          ON a.pair_id = k.pair_id AND a.target = lower(k.word)""",
    ),
)
def word_level(spark, sf_dir):
    """Every distinct Kazakh word of every text, asked for in capitals."""
    asked = _pairs(spark, sf_dir).select(
        "pair_id", F.explode(F.array_distinct(t.words(_capitals("kaz")))).alias("word")
    )
    graded = materialise(_graded_phrases(spark, sf_dir))  # read for the texts and for their words
    texts = scoring.distribution_per(graded, ["pair_id"])
    found = scoring.find_words(asked, scoring.word_alignments(graded), texts)
    return found.select(
        "pair_id", "word", "kazakh_token", "russian_token", "kazakh_index", "russian_index",
        "level", r6("confidence").alias("confidence"),
    )


def _word_probs(spark, sf_dir):
    words = _pairs(spark, sf_dir).select(F.explode(t.words(F.col("rus"))).alias("word"))
    return score_words(words, fx.digest_word_model)


def two_to_one_sql(minimum: float) -> str:
    return q.query(
        "phrases",
        f"""SELECT pair_id, phrase AS kazakh_phrase, token AS russian_token, span AS kazakh_span,
          russian_index, round(conf, 6) AS alignment_conf, {q.top_level('p')} AS russian_cefr_level,
          round(list_max(p), 6) AS russian_cefr_confidence
        FROM (SELECT *, {q.digest_probs('token')} AS p FROM phrases
              WHERE n_words = 2 AND conf >= {minimum})""",
    )


def _two_to_one(spark, sf_dir, minimum):
    rows = grading.two_to_one(phrased(spark, sf_dir), fx.digest_word_model, minimum)
    return rows.select(
        "pair_id", "kazakh_phrase", "russian_token",
        F.array_join(F.col("kazakh_span").cast("array<string>"), ",").alias("kazakh_span"),
        "russian_index", r6("alignment_conf").alias("alignment_conf"), "russian_cefr_level",
        r6("russian_cefr_confidence").alias("russian_cefr_confidence"),
    )


@register("two_to_one", two_to_one_sql(0.2))
def two_to_one(spark, sf_dir):
    return _two_to_one(spark, sf_dir, 0.2)


PROBS_SQL = ", ".join(f"round(p[{i + 1}], 6) AS p_{lv.lower()}" for i, lv in enumerate(LEVELS))


def _probs(column="probs"):
    return [r6(F.get(column, F.lit(i))).alias(f"p_{lv.lower()}") for i, lv in enumerate(LEVELS)]


@register(
    "word_scores",
    q.query(
        "rus_tokens",
        f"""SELECT word, {PROBS_SQL} FROM (SELECT token AS word, {q.digest_probs('token')} AS p
        FROM (SELECT DISTINCT token FROM rus_tokens))""",
    ),
)
def word_scores(spark, sf_dir):
    return _word_probs(spark, sf_dir).select("word", *_probs())


@register(
    "word_top_levels",
    q.query(
        "rus_tokens",
        f"""SELECT pair_id, word_idx AS pos, token AS word, {q.top_level('p')} AS level,
          round(list_max(p), 6) AS probability
        FROM (SELECT *, {q.digest_probs('token')} AS p FROM rus_tokens)""",
    ),
)
def word_top_levels(spark, sf_dir):
    rows = word_predictions(_pairs(spark, sf_dir), _word_probs(spark, sf_dir), "pair_id", "rus")
    return rows.select("pair_id", "pos", "word", "level", r6("probability").alias("probability"))


@register(
    "word_report",
    q.query(
        "translated translated_tokens",
        f"""SELECT p.pair_id, md5(p.rus) AS rus, translation_used, n IS NULL AS no_tokens,
          coalesce(n, 0) AS n, levels
        FROM translated p LEFT JOIN (
          SELECT pair_id, count(*) AS n,
            md5(string_agg(token || ':' || {q.top_level('p')}, '|' ORDER BY word_idx)) AS levels
          FROM (SELECT *, {q.digest_probs('token')} AS p FROM translated_tokens) GROUP BY pair_id) w
        ON w.pair_id = p.pair_id""",
    ),
)
def word_report(spark, sf_dir):
    report = grading.word_report(
        _untranslated(spark, sf_dir), _word_probs(spark, sf_dir), fx.translations(spark, sf_dir)
    )
    line = F.transform("words", lambda w: F.concat(w["word"], F.lit(":"), w["level"]))
    return report.select(
        "pair_id",
        F.md5(F.col("rus").cast("binary")).alias("rus"),
        "translation_used",
        "no_tokens",
        F.coalesce(F.size("words"), F.lit(0)).alias("n"),
        F.md5(F.array_join(line, "|").cast("binary")).alias("levels"),
    )


@register(
    "sentence_level",
    q.query(
        "pairs",
        f"""SELECT pair_id, {q.top_level('p')} AS level, round(list_max(p), 6) AS confidence,
          {PROBS_SQL} FROM (SELECT pair_id, {q.digest_probs('rus')} AS p FROM pairs)""",
    ),
)
def sentence_level(spark, sf_dir):
    probs = fx.sentence_probs(_pairs(spark, sf_dir))
    return probs.select(
        "pair_id",
        d.top_level(F.col("probs")).alias("level"),
        r6(d.top_probability(F.col("probs"))).alias("confidence"),
        *_probs(),
    )


_MIXED = ", ".join(
    f"0.6::DOUBLE * s[{i + 1}] + 0.4::DOUBLE * dist[{i + 1}]" for i in range(6)
)


@register(
    "ensemble",
    q.query(
        "levels_tr translated graded_tr",
        f"""SELECT pair_id, md5(rus) AS rus, translation_used,
          (SELECT count(*) FROM graded_tr g WHERE g.pair_id = m.pair_id) AS phrases,
          {q.top_level('p')} AS level, round(list_max(p), 6) AS confidence, {PROBS_SQL}
        FROM (SELECT pair_id, rus, translation_used, CASE WHEN list_sum(m) > 0
                THEN list_transform(m, lambda x: x / list_sum(m))
                ELSE list_transform(m, lambda x: 1.0::DOUBLE / 6) END AS p
              FROM (SELECT v.pair_id, rus, translation_used, [{_MIXED}] AS m
                    FROM (SELECT l.pair_id, l.dist, p.rus, p.translation_used, {q.digest_probs('rus')} AS s
                          FROM levels_tr l JOIN translated p ON p.pair_id = l.pair_id) v)) m""",
    ),
)
def ensemble(spark, sf_dir):
    sides = materialise(
        grading.translated(_untranslated(spark, sf_dir), fx.translations(spark, sf_dir))
    )
    texts = grading.grade_texts(sides, _lexicon(spark, sf_dir), fx.encoder(spark, sf_dir))
    blended = scoring.ensemble(texts, fx.sentence_probs(sides), 0.6)
    return blended.select(
        "pair_id",
        F.md5(F.col("rus").cast("binary")).alias("rus"),
        "translation_used",
        F.size("phrase_alignments").alias("phrases"),
        "level",
        r6("confidence").alias("confidence"),
        *_probs("probabilities"),
    )
