"""Words, sentences, numbers, scripts, text statistics."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import sql as q
from catalog.registry import list_digest, r6, register
from lexigrade.functions import text as t
from lexigrade.functions.features import TEXT_FEATURES, with_bilingual_ratios, with_text_features

RATIOS = ("aligned_token_ratio", "aligned_sentence_ratio", "syllable_ratio")
INTEGER = ("sentence_count", "token_count", "type_count", "number_count", "syllable_count")


def _list_sql(pattern_sql: str) -> str:
    return q.query(
        "docs",
        f"""SELECT doc_id, len(l) AS n, md5(array_to_string(l, '|')) AS digest
        FROM (SELECT doc_id, {pattern_sql} AS l FROM docs)""",
    )


def _listed(spark, sf_dir, split):
    lists = fx.documents(spark, sf_dir).select("doc_id", split(F.col("text")).alias("l"))
    return lists.select("doc_id", F.size("l").alias("n"), list_digest("l").alias("digest"))


@register("tokenize_words", _list_sql(q.words("text")))
def tokenize_words(spark, sf_dir):
    return _listed(spark, sf_dir, t.words)


@register("blank_split", _list_sql(q.find_all("text", q.NON_BLANK)))
def blank_split(spark, sf_dir):
    return _listed(spark, sf_dir, t.blank_split)


@register("extract_numbers", _list_sql(q.find_all("text", q.NUMBER)))
def extract_numbers(spark, sf_dir):
    return _listed(spark, sf_dir, t.numbers)


@register(
    "split_sentences",
    _list_sql(
        f"""list_filter(list_transform({q.find_all('text', q.SENTENCE)},
        lambda x: {q.strip('x')}), lambda x: x <> '')"""
    ),
)
def split_sentences(spark, sf_dir):
    return _listed(spark, sf_dir, t.sentences)


@register(
    "ngram_terms",
    q.query(
        "docs",
        f"""SELECT doc_id, len(l) AS n, md5(array_to_string(l, '|')) AS digest FROM (
          SELECT doc_id, list_concat(w, list_transform(range(1, len(w)),
            lambda i: w[i] || ' ' || w[i + 1])) AS l
          FROM (SELECT doc_id, {q.find_all('lower(text)', q.TERM)} AS w FROM docs))""",
    ),
)
def ngram_terms(spark, sf_dir):
    return _listed(spark, sf_dir, lambda text: t.terms(text, 2))


@register(
    "strip_lower",
    q.query("lexicon_raw", f"SELECT row_id, {q.strip_lower('word')} AS word FROM lexicon_raw"),
)
def strip_lower(spark, sf_dir):
    return fx.lexicon_raw(spark, sf_dir).select("row_id", t.strip_lower(F.col("word")).alias("word"))


def _distinct_words(spark, sf_dir):
    return (
        fx.documents(spark, sf_dir).select(F.explode(t.words(F.col("text"))).alias("word")).distinct()
    )


DISTINCT_WORDS = f"(SELECT DISTINCT unnest({q.words('text')}) AS word FROM docs)"


@register(
    "script_filter",
    q.query(
        "docs",
        f"""SELECT word, {q.cyrillic('word')} AS is_cyrillic,
        {q.cyrillic('word')} AS is_informative FROM {DISTINCT_WORDS}""",
    ),
)
def script_filter(spark, sf_dir):
    return _distinct_words(spark, sf_dir).select(
        "word",
        t.is_cyrillic(F.col("word")).alias("is_cyrillic"),
        t.is_informative(F.col("word")).alias("is_informative"),
    )


@register(
    "count_syllables",
    q.query("docs", f"SELECT word, {q.syllables('word')} AS n FROM {DISTINCT_WORDS}"),
)
def count_syllables(spark, sf_dir):
    return _distinct_words(spark, sf_dir).select("word", t.syllables(F.col("word")).alias("n"))


@register(
    "words_minus_numbers",
    q.query(
        "docs",
        f"""SELECT doc_id, len(l) AS n, md5(array_to_string(l, '|')) AS digest
        FROM (SELECT doc_id, list_filter({q.words('text')}, lambda w: NOT list_contains(
                {q.find_all('text', q.NUMBER)}, w)) AS l FROM docs)""",
    ),
)
def words_minus_numbers(spark, sf_dir):
    docs = fx.documents(spark, sf_dir).select(
        "doc_id",
        t.words(F.col("text")).alias("w"),
        F.array_distinct(t.numbers(F.col("text"))).alias("n"),
    )
    kept = docs.select("doc_id", t.words_without_numbers(F.col("w"), F.col("n")).alias("l"))
    return kept.select("doc_id", F.size("l").alias("n"), list_digest("l").alias("digest"))


def _rounded(names):
    return ", ".join(n if n.endswith(INTEGER) else f"round({n}, 6) AS {n}" for n in names)


@register(
    "text_features",
    q.query(
        "docs", f"SELECT doc_id, {_rounded(TEXT_FEATURES)} FROM ({q.features('docs', 'doc_id', 'text')})"
    ),
)
def text_features(spark, sf_dir):
    featured = with_text_features(fx.documents(spark, sf_dir), "text")
    return featured.select(
        "doc_id", *[n if n in INTEGER else r6(n).alias(n) for n in TEXT_FEATURES]
    )


_EN = [f"en_{n}" for n in TEXT_FEATURES]
_RU = [f"ru_{n}" for n in TEXT_FEATURES]


def bilingual_sql(columns: str, needs: str = "text_corpus") -> str:
    return q.query(
        needs,
        f"""SELECT {columns} FROM (SELECT e.*, r.* EXCLUDE (doc_id),
          {q.ratio('en_token_count', 'ru_token_count')} AS aligned_token_ratio,
          {q.ratio('en_sentence_count', 'ru_sentence_count')} AS aligned_sentence_ratio,
          {q.ratio('en_syllable_count', 'ru_syllable_count')} AS syllable_ratio
        FROM ({q.features('text_corpus', 'doc_id', 'text_en', 'en_')}) e
        JOIN ({q.features('text_corpus', 'doc_id', 'text_ru', 'ru_')}) r ON r.doc_id = e.doc_id)""",
    )


@register("bilingual_ratios", bilingual_sql(f"doc_id, {_rounded([*_EN, *_RU, *RATIOS])}"))
def bilingual_ratios(spark, sf_dir):
    from lexigrade.sources.corpora import text_corpus

    corpus = text_corpus(fx.text_corpus(spark, sf_dir))
    featured = with_text_features(with_text_features(corpus, "text_en", "en_"), "text_ru", "ru_")
    ratios = with_bilingual_ratios(featured)
    return ratios.select(
        "doc_id", *[n if n.endswith(INTEGER) else r6(n).alias(n) for n in [*_EN, *_RU, *RATIOS]]
    )
