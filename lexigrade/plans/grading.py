"""Grading texts: translation, alignment, lexicon levels, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrade.functions import distributions as d
from lexigrade.functions import text as t
from lexigrade.operators import align, scoring
from lexigrade.operators.joins import lookup_join
from lexigrade.operators.lexicon import attach_level
from lexigrade.operators.translate import translate_words
from lexigrade.operators.word_model import score_words, word_predictions
from lexigrade.session import materialise, spread

Encoder = Callable[[DataFrame], DataFrame]


def with_translation(
    texts: DataFrame, translations: DataFrame, row_key: list[str], **bounds
) -> DataFrame:
    """Fill `rus` (the given translation) from (src_text, tgt_text) where it is empty.

    The translations found are looked up for (row key, digest) alone, by a 128-bit digest of
    the source, and joined to the texts by the row key; a source copied many times is spread
    over several tasks. Of repeated sources the smallest target is taken. Adds
    `translation_used`.
    """
    given = F.col("rus")
    has_given = F.coalesce(given != "", F.lit(False))
    lookup = translations.groupBy(F.md5(F.col("src_text").cast("binary")).alias("_digest")).agg(
        F.min("tgt_text").alias("_tgt")
    )
    asked = texts.where(~has_given).select(
        *row_key, F.md5(F.coalesce("kaz", F.lit("")).cast("binary")).alias("_digest")
    )
    found = lookup_join(asked, lookup, "_digest", row_key=row_key, **bounds).drop("_digest")
    return texts.join(found, row_key, "left").select(
        *[c for c in texts.columns if c != "rus"],
        F.when(has_given, given).otherwise(F.coalesce("_tgt", F.lit(""))).alias("rus"),
        (~has_given).alias("translation_used"),
    )


def translated(texts: DataFrame, translations: DataFrame | None, **bounds) -> DataFrame:
    """`texts` (pair_id, kaz, rus) with every `rus` filled; without a table they are as given.

    Texts that come translated from here keep their `translation_used`.
    """
    if translations is None:
        filled = texts.withColumn("rus", F.coalesce("rus", F.lit("")))
        return filled if "translation_used" in texts.columns else filled.withColumn("translation_used", F.lit(False))
    return with_translation(texts, translations, ["pair_id"], **bounds)


def translated_with_words(
    texts: DataFrame, translations: DataFrame, best: DataFrame, **bounds
) -> DataFrame:
    """`translated`, and texts that no table knows word by word with `translate.best_targets`.

    Adds `source`: given, table or words. The texts are written once translated from the table, as
    those it doesn't know are taken out of them.
    """
    ready = materialise(with_translation(texts, translations, ["pair_id"], **bounds))
    open_ = ready.where("translation_used AND rus = '' AND kaz <> ''")
    made = translate_words(open_, best, "pair_id", "kaz", **bounds).select("pair_id", "translation")
    source = (
        F.when(~F.col("translation_used"), "given")
        .when(F.col("translation").isNotNull(), "words")
        .otherwise("table")
    )
    joined = ready.join(made, "pair_id", "left")
    kept = [c for c in ready.columns if c != "rus"]
    return joined.select(*kept, F.coalesce("translation", "rus").alias("rus"), source.alias("source"))


def aligned_phrases(
    pairs: DataFrame, encode: Encoder, threshold: float = align.LINK_THRESHOLD, texts: bool = True
) -> DataFrame:
    """(pair_id, kaz, rus, …) → the same rows with words, links and phrases; without `texts` less kaz and rus.

    The one shuffle on `pair_id` moves the bare texts. Everything an encoder needs to
    gather per pair afterwards (see `attach_piece_vectors`) finds its rows in place, so
    no vector is ever shuffled.
    """
    words = align.with_words(spread(pairs, "pair_id"))
    words = words if texts else words.drop("kaz", "rus")
    return align.with_phrases(align.with_links(encode(words), threshold))


def graded_phrases(phrased: DataFrame, lexicon: DataFrame, **bounds) -> DataFrame:
    """One row per phrase with the level of its Russian word; empty pairs keep a row.

    Neither texts nor word lists go along: repeated on every phrase they would grow with the
    square of the text. Who needs them joins them by pair.
    """
    rows = align.phrase_rows(phrased.select("pair_id", "too_long", "phrases"), outer=True)
    return attach_level(
        rows, lexicon, "russian_token", row_key=["pair_id", "russian_index", "kazakh_phrase"],
        **bounds,
    )


def grade_texts(
    pairs: DataFrame,
    lexicon: DataFrame,
    encode: Encoder,
    threshold: float = align.LINK_THRESHOLD,
    translations: DataFrame | None = None,
) -> DataFrame:
    """One row per text: its translation, shares per level, average level, word alignments.

    A text without a given translation takes it from `translations`; the texts are then written, as
    they are read for the alignment and joined to its result. Texts too long for the encoder keep
    a flagged row without a level.
    """
    texts = translated(pairs, translations)
    if translations is not None:
        texts = materialise(texts)
    phrases = graded_phrases(aligned_phrases(texts, encode, threshold, texts=False), lexicon)
    alignment = F.struct(
        "russian_index", "kazakh_span", "kazakh_phrase", "russian_token", "level"
    )
    graded = scoring.distribution_per(
        phrases,
        ["pair_id"],
        extra=(
            F.first("too_long").alias("too_long"),
            F.sort_array(
                F.collect_list(F.when(F.col("russian_index").isNotNull(), alignment))
            ).alias("phrase_alignments"),
        ),
    )
    return graded.join(texts.select("pair_id", "rus", "translation_used"), "pair_id")


def text_levels(
    pairs: DataFrame,
    lexicon: DataFrame,
    encode: Encoder,
    threshold: float = align.LINK_THRESHOLD,
    translations: DataFrame | None = None,
) -> DataFrame:
    """(pair_id, rus, translation_used, too_long, cefr_level, confidence, distribution) per text."""
    return scoring.text_report(
        grade_texts(pairs, lexicon, encode, threshold, translations).drop("phrase_alignments")
    )


def two_to_one(
    phrased: DataFrame,
    word_probs: DataFrame | Callable[[DataFrame], DataFrame],
    min_confidence: float = 0.8,
    **bounds,
) -> DataFrame:
    """Two Kazakh words against one Russian word, with the word model's level of it.

    `word_probs` is a table, or a model (see `score_words`) that then scores the words of the
    phrases that are left, and no others.

    p(kz|ru) sums to one over the Kazakh words, so two links of one Russian word cannot
    both exceed 0.5: the default confidence always gives an empty result.
    """
    rows = align.phrase_rows(phrased.select("pair_id", "phrases"))
    chosen = align.confident(align.spans_of(rows, 2), min_confidence)
    if callable(word_probs):
        chosen = materialise(chosen)
        word_probs = score_words(chosen.select(F.col("russian_token").alias("word")), word_probs)
    graded = word_levels_of(
        chosen, word_probs, "russian_token",
        row_key=["pair_id", "russian_index", "kazakh_phrase"], **bounds,
    )
    return graded.select(
        "pair_id",
        "kazakh_phrase",
        "russian_token",
        "kazakh_span",
        "russian_index",
        "alignment_conf",
        d.top_level(F.col("probs")).alias("russian_cefr_level"),
        d.top_probability(F.col("probs")).alias("russian_cefr_confidence"),
    )


def word_levels_of(
    rows: DataFrame, word_probs: DataFrame, token_col: str, *, row_key: list[str], **bounds
) -> DataFrame:
    """Add `probs` of a token column."""
    keyed = rows.withColumn("_word", t.strip(F.col(token_col)))
    table = word_probs.select(F.col("word").alias("_word"), "probs")
    return lookup_join(keyed, table, "_word", row_key=row_key, **bounds).drop("_word")


def word_report(
    texts: DataFrame, word_probs: DataFrame, translations: DataFrame | None = None, **bounds
) -> DataFrame:
    """Per text (pair_id, kaz, rus): its translation's words in order, each with level and probability.

    A text whose translation has no words keeps a row flagged `no_tokens`.
    """
    ready = translated(texts, translations, **bounds)
    scored = word_predictions(ready, word_probs, "pair_id", "rus", **bounds)
    folded = scored.groupBy("pair_id").agg(
        F.sort_array(
            F.collect_list(F.struct("pos", "word", "level", "probability", "probs"))
        ).alias("words")
    )
    return ready.select("pair_id", "rus", "translation_used").join(folded, "pair_id", "left").select(
        "pair_id",
        "rus",
        "translation_used",
        F.col("words").isNull().alias("no_tokens"),
        "words",
    )
