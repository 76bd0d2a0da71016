"""Level lexicon and lemma dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrade.functions.text import strip, strip_lower
from lexigrade.levels import UNKNOWN
from lexigrade.operators.joins import lookup_join


def build_lexicon(raw: DataFrame) -> DataFrame:
    """(row_id, word, level) → (word, level): keys trimmed and lower-cased, last row wins."""
    cleaned = raw.select(
        "row_id", strip_lower(F.col("word")).alias("word"), strip(F.col("level")).alias("level")
    )
    return (
        cleaned.where(F.col("word") != "")
        .groupBy("word")
        .agg(F.max_by("level", "row_id").alias("level"))
    )


def attach_level(
    tokens: DataFrame, lexicon: DataFrame, token_col: str, *, row_key: list[str], **bounds
) -> DataFrame:
    """Add `level` by the normalised token; `Unknown` where the lexicon has none."""
    keyed = tokens.withColumn("_word", strip_lower(F.col(token_col)))
    entries = lexicon.select(F.col("word").alias("_word"), F.col("level").alias("_level"))
    found = lookup_join(keyed, entries, "_word", row_key=row_key, **bounds)
    return found.select(
        *tokens.columns, F.coalesce(F.col("_level"), F.lit(UNKNOWN)).alias("level")
    )


def attach_lemma_level(
    tokens: DataFrame,
    lexicon: DataFrame,
    lemmas: DataFrame,
    token_col: str,
    *,
    row_key: list[str],
    **bounds,
) -> DataFrame:
    """Add `lemma` and `level`: by lemma if the lexicon has it, else by the token itself.

    A token absent from the lemma dictionary is its own lemma.
    """
    known = lemma_levels(lexicon, lemmas).select(
        F.col("word").alias("_word"), F.col("lemma").alias("_lemma"), F.col("level").alias("_level")
    )
    keyed = tokens.withColumn("_word", strip_lower(F.col(token_col)))
    found = lookup_join(keyed, known, "_word", row_key=row_key, **bounds)
    return found.select(
        *tokens.columns,
        F.coalesce("_lemma", "_word").alias("lemma"),
        F.coalesce(F.col("_level"), F.lit(UNKNOWN)).alias("level"),
    )


def lemma_levels(lexicon: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(word, lemma, level) for every word of either dictionary: what one look-up has to find.

    Joins the dictionaries with each other, whose words are distinct, instead of the corpus
    with three tables in turn.
    """
    lemma_of = lemmas.select(F.col("token").alias("word"), "lemma")
    by_lemma = lexicon.select(F.col("word").alias("lemma"), F.col("level").alias("_lemma_level"))
    return (
        lemma_of.join(by_lemma, "lemma", "left")
        .join(lexicon, "word", "full")
        .select(
            "word",
            F.coalesce("lemma", "word").alias("lemma"),
            F.coalesce("_lemma_level", "level").alias("level"),
        )
    )
