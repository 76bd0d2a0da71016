"""Input tables: cleaning, lexicon, look-ups, translations."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import sql as q
from catalog.registry import r6, register
from lexigrade.functions import text as t
from lexigrade.operators.lexicon import attach_lemma_level, attach_level, build_lexicon
from lexigrade.plans.grading import with_translation
from lexigrade.sources import corpora


def _digest(name):
    return F.md5(F.col(name).cast("binary")).alias(name)


@register(
    "parallel_corpus",
    q.query(
        "pairs",
        f"""SELECT pair_id, md5(kaz) AS kaz, length(kaz) AS kaz_chars, md5(rus) AS rus
        FROM (SELECT pair_id, {q.strip('kaz')} AS kaz,
                CASE WHEN role = 'user' THEN '' ELSE {q.strip('rus')} END AS rus FROM pairs)""",
    ),
)
def parallel_corpus(spark, sf_dir):
    raw = fx.pairs(spark, sf_dir).select(
        "pair_id",
        F.concat(F.lit("  "), "kaz", F.lit("\n")).alias("kaz"),
        F.when(F.col("role") != "user", F.col("rus")).alias("rus"),
    )
    return corpora.parallel_corpus(raw).select(
        "pair_id", F.length("kaz").alias("kaz_chars"), _digest("kaz"), _digest("rus")
    )


@register(
    "first_pairs",
    q.query("pairs", "SELECT pair_id, md5(kaz) AS kaz FROM pairs ORDER BY pair_id LIMIT 100"),
)
def first_pairs(spark, sf_dir):
    return corpora.first_pairs(fx.pairs(spark, sf_dir), 100).select("pair_id", _digest("kaz"))


@register(
    "ingest_bitext",
    f"""SELECT pair_id, md5({q.strip("replace(kk, chr(10), ' ')")}) AS kaz,
      md5({q.strip("replace(ru, chr(10), ' ')")}) AS rus
    FROM (SELECT conv_id * 4294967296 + turn AS pair_id, chr(10) || text AS kk,
            CASE role WHEN 'user' THEN text WHEN 'assistant' THEN ' ' ELSE '' END AS ru
          FROM conversations)
    WHERE length(kk) > 0 AND length(ru) > 0""",
)
def ingest_bitext(spark, sf_dir):
    role = F.col("role")
    raw = fx.table(spark, sf_dir, "conversations").select(
        fx.turn_id().alias("pair_id"),
        F.concat(F.lit("\n"), "text").alias("kk"),
        F.when(role == "user", F.col("text"))
        .when(role == "assistant", F.lit(" "))
        .otherwise(F.lit(""))
        .alias("ru"),
    )
    return corpora.ingest_bitext(raw).select("pair_id", _digest("kaz"), _digest("rus"))


@register("lexicon_build", q.query("lexicon", "SELECT word, level FROM lexicon"))
def lexicon_build(spark, sf_dir):
    return build_lexicon(fx.lexicon_raw(spark, sf_dir))


def _tokens(spark, sf_dir):
    return fx.pairs(spark, sf_dir).select(
        "pair_id", F.posexplode(t.words(F.col("rus"))).alias("word_idx", "token")
    )


@register(
    "lexicon_lookup",
    q.query(
        "rus_tokens lexicon",
        f"""SELECT pair_id, word_idx, token, coalesce(level, 'Unknown') AS level
        FROM rus_tokens LEFT JOIN lexicon ON word = {q.strip_lower('token')}""",
    ),
)
def lexicon_lookup(spark, sf_dir):
    lexicon = build_lexicon(fx.lexicon_raw(spark, sf_dir))
    return attach_level(_tokens(spark, sf_dir), lexicon, "token", row_key=["pair_id", "word_idx"])


@register(
    "lemma_lookup",
    q.query(
        "rus_tokens lexicon lemmas",
        f"""SELECT pair_id, word_idx, r.token, coalesce(m.lemma, {q.strip_lower('r.token')}) AS lemma,
          coalesce(a.level, b.level, 'Unknown') AS level
        FROM rus_tokens r LEFT JOIN lemmas m ON m.token = {q.strip_lower('r.token')}
        LEFT JOIN lexicon a ON a.word = coalesce(m.lemma, {q.strip_lower('r.token')})
        LEFT JOIN lexicon b ON b.word = {q.strip_lower('r.token')}""",
    ),
)
def lemma_lookup(spark, sf_dir):
    return attach_lemma_level(
        _tokens(spark, sf_dir),
        build_lexicon(fx.lexicon_raw(spark, sf_dir)),
        fx.lemmas(spark, sf_dir),
        "token",
        row_key=["pair_id", "word_idx"],
    )


@register(
    "text_corpus",
    q.query(
        "text_corpus_gaps",
        """SELECT doc_id, label, md5(text_en) AS text_en, md5(text_ru) AS text_ru
        FROM text_corpus_gaps""",
    ),
)
def text_corpus(spark, sf_dir):
    return corpora.text_corpus(fx.text_corpus(spark, sf_dir, gaps=True)).select(
        "doc_id", "label", _digest("text_en"), _digest("text_ru")
    )


@register(
    "language_columns",
    q.query("text_corpus", "SELECT doc_id, label, md5(text_ru) AS text_ru, '' AS text_en FROM text_corpus"),
)
def language_columns(spark, sf_dir):
    """English left out: its column is absent and reads as ''."""
    raw = fx.text_corpus(spark, sf_dir).drop("text_en")
    corpus = corpora.text_corpus(raw, english=False)
    (kept,) = corpora.text_columns(english=False, russian=True)
    return corpus.select("doc_id", "label", _digest(kept), "text_en")


@register(
    "tabular_corpus",
    q.query(
        "tabular_gaps",
        "SELECT pair_id, md5(kaz) AS kaz, md5(rus) AS rus, predicted_cefr, "
        + ", ".join(f"round({n}, 6) AS {n}" for n in corpora.TABULAR_NUMERIC)
        + " FROM tabular_gaps",
    ),
)
def tabular_corpus(spark, sf_dir):
    corpus = corpora.tabular_corpus(fx.tabular_raw(spark, sf_dir, gaps=True))
    numeric = [r6(n).alias(n) for n in corpora.TABULAR_NUMERIC]
    return corpus.select("pair_id", "predicted_cefr", _digest("kaz"), _digest("rus"), *numeric)


@register(
    "translation_override",
    q.query(
        "pairs",
        """SELECT p.pair_id, coalesce(p.role, '') <> 'user' AS translation_used,
          md5(CASE WHEN p.role = 'user' THEN p.rus ELSE coalesce(d.tgt, '') END) AS rus
        FROM pairs p LEFT JOIN (SELECT kaz, arg_min(rus, pair_id) AS tgt FROM pairs GROUP BY kaz) d
          ON d.kaz = p.kaz AND (p.pair_id >> 32) % 2 = 0""",
    ),
)
def translation_override(spark, sf_dir):
    translated = with_translation(
        fx.untranslated(spark, sf_dir), fx.translations(spark, sf_dir), row_key=["pair_id"]
    )
    return translated.select("pair_id", "translation_used", _digest("rus"))
