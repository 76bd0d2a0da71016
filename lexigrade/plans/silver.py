"""Word labels from a parallel corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexigrade.functions.text import is_cyrillic, is_informative
from lexigrade.operators import align
from lexigrade.operators.lexicon import attach_lemma_level
from lexigrade.plans.grading import Encoder, aligned_phrases
from lexigrade.sources.corpora import SILVER_COLUMNS, first_pairs, parallel_corpus


def label_phrases(
    phrased: DataFrame,
    lexicon: DataFrame,
    lemmas: DataFrame,
    skip_non_informative: bool = True,
    **bounds,
) -> DataFrame:
    """One row per phrase with a Cyrillic Russian word; `Unknown` levels are kept.

    Where `phrased` comes without its texts the labels have no `kaz_sent` and `rus_sent`.
    """
    texts = [c for c in ("kaz", "rus") if c in phrased.columns]
    rows = align.phrase_rows(
        phrased.select("pair_id", *texts, "phrases")
    ).where(is_cyrillic(F.col("russian_token")))
    if skip_non_informative:
        rows = rows.where(is_informative(F.col("russian_token")))
    graded = attach_lemma_level(
        rows, lexicon, lemmas, "russian_token",
        row_key=["pair_id", "russian_index", "kazakh_phrase"], **bounds,
    )
    return graded.select(
        "pair_id",
        "russian_index",
        F.get("kazakh_span", F.lit(0)).alias("span_start"),
        F.col("kazakh_phrase").alias("kaz_item"),
        F.col("russian_token").alias("rus_item"),
        F.col("level").alias("cefr"),
        *[F.col(c).alias(f"{c}_sent") for c in texts],
    )


def silver_labels(
    raw_pairs: DataFrame,
    lexicon: DataFrame,
    lemmas: DataFrame,
    encode: Encoder,
    *,
    threshold: float = align.LINK_THRESHOLD,
    size: int | None = None,
    skip_non_informative: bool = True,
    sentences: bool = True,
) -> DataFrame:
    """Word labels of a parallel corpus; without `sentences` no text goes beyond the cutting of its words."""
    pairs = first_pairs(parallel_corpus(raw_pairs), size)
    phrased = aligned_phrases(pairs, encode, threshold, texts=sentences)
    return label_phrases(phrased, lexicon, lemmas, skip_non_informative)


def skipped_pairs(phrased: DataFrame) -> DataFrame:
    """Counts of all pairs, of those too long, and of those that gave no phrase."""
    empty = F.size("phrases") == 0
    return phrased.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if("too_long").alias("too_long"),
        F.count_if(empty).alias("skipped"),
    )


def write_silver_labels(
    raw_pairs: DataFrame,
    lexicon: DataFrame,
    lemmas: DataFrame,
    encode: Encoder,
    path: str,
    *,
    form: str = "csv",
    threshold: float = align.LINK_THRESHOLD,
    size: int | None = None,
) -> dict[str, int]:
    """Write the five label columns and return {rows, skipped}, counted on the way."""
    pairs = first_pairs(parallel_corpus(raw_pairs), size)
    pair_seen, row_seen = Observation(), Observation()
    phrased = aligned_phrases(pairs, encode, threshold).observe(
        pair_seen, F.count_if(F.size("phrases") == 0).alias("skipped")
    )
    labels = label_phrases(phrased, lexicon, lemmas).select(*SILVER_COLUMNS)
    writer = labels.observe(row_seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if form == "csv":
        writer.options(header=True, escape='"').csv(path)
    else:
        writer.format(form).save(path)
    return {"rows": row_seen.get["rows"], "skipped": pair_seen.get["skipped"]}
