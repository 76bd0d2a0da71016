"""From graded phrases to text and word levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrade.functions import distributions as d
from lexigrade.functions.text import is_cyrillic
from lexigrade.levels import LEVELS


def distribution_per(
    phrases: DataFrame, keys: list[str], token_col: str = "russian_token", extra: tuple = ()
) -> DataFrame:
    """Group graded phrases to `distribution` and `average_level`.

    Phrases count, not tokens. Non-Cyrillic tokens and levels off the scale leave the
    denominator; a group without any known phrase gets zeros and `Unknown`.
    """
    names = [f"_n{i}" for i in range(len(LEVELS))]
    counted = phrases.withColumn("_level", F.when(is_cyrillic(F.col(token_col)), F.col("level")))
    counts = [F.count_if(F.col("_level") == level).alias(n) for level, n in zip(LEVELS, names)]
    grouped = counted.groupBy(*keys).agg(*counts, *extra)
    kept = [c for c in grouped.columns if c not in names]
    return grouped.select(
        *kept, d.shares([F.col(n) for n in names]).alias("distribution")
    ).select("*", d.average_level(F.col("distribution")).alias("average_level"))


def word_alignments(phrases: DataFrame) -> DataFrame:
    """One row per Kazakh word of each graded phrase."""
    word = F.arrays_zip(
        F.col("kazakh_tokens").alias("token"), F.col("kazakh_span").alias("index")
    )
    return phrases.select(
        "pair_id",
        "russian_token",
        "russian_index",
        "level",
        F.get("kazakh_span", F.lit(0)).alias("span_start"),
        F.explode(word).alias("_w"),
    ).select(
        "pair_id",
        F.col("_w.token").alias("kazakh_token"),
        "russian_token",
        F.col("_w.index").alias("kazakh_index"),
        "russian_index",
        "level",
        "span_start",
    )


def text_report(texts: DataFrame) -> DataFrame:
    """Level, its share as confidence, and the six shares as columns."""
    return texts.select(
        *[c for c in texts.columns if c not in ("distribution", "average_level")],
        F.col("average_level").alias("cefr_level"),
        d.share_of(F.col("distribution"), F.col("average_level")).alias("confidence"),
        "distribution",
    )


def find_words(
    queries: DataFrame, alignments: DataFrame, texts: DataFrame, case_insensitive: bool = True
) -> DataFrame:
    """Level of a queried word (pair_id, word): its first alignment in text order.

    The confidence is the share that level has in the whole text. A word that is not
    aligned keeps a row of NULLs.
    """
    fold = F.lower if case_insensitive else (lambda c: c)
    order = F.struct("russian_index", "span_start", "kazakh_index")
    first = (
        alignments.groupBy("pair_id", fold(F.col("kazakh_token")).alias("_target"))
        .agg(
            F.min_by(
                F.struct(
                    "kazakh_token", "russian_token", "kazakh_index", "russian_index", "level"
                ),
                order,
            ).alias("_a")
        )
    )
    asked = queries.withColumn("_target", fold(F.col("word")))
    shares = texts.select("pair_id", "distribution")
    return (
        asked.join(first, ["pair_id", "_target"], "left")
        .join(shares, "pair_id", "left")
        .select(
            *queries.columns,
            "_a.*",
            F.when(
                F.col("_a").isNotNull(), d.share_of(F.col("distribution"), F.col("_a.level"))
            ).alias("confidence"),
            "distribution",
        )
    )


def ensemble(texts: DataFrame, sentence_probs: DataFrame, weight: float = 0.6) -> DataFrame:
    """Blend lexicon distributions with a sentence model's, both keyed by pair_id.

    What else the graded texts carry (translation, word alignments) stays in the row.
    """
    joined = texts.join(sentence_probs, "pair_id", "left")
    others = [c for c in texts.columns if c not in ("pair_id", "distribution", "average_level")]
    zeros = F.array(*[F.lit(0.0) for _ in LEVELS])
    mixed = joined.select(
        "pair_id",
        *others,
        F.col("distribution").alias("kazakh_distribution"),
        F.coalesce("probs", zeros).alias("russian_distribution"),
    ).select(
        "*",
        d.blend(F.col("russian_distribution"), F.col("kazakh_distribution"), weight).alias(
            "probabilities"
        ),
    )
    return mixed.select(
        "pair_id",
        d.top_level(F.col("probabilities")).alias("level"),
        d.top_probability(F.col("probabilities")).alias("confidence"),
        "probabilities",
        "kazakh_distribution",
        "russian_distribution",
        *others,
    )
