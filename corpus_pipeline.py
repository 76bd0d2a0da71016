"""A corpus in five stages: language, exact copies, near copies, benchmark passages, packing.

Each stage takes all documents that the one before kept, written as Parquet and read again;
all but the last return the columns of documents. Rows are told apart by numbers
that are written with them once, so repeated or missing ids lose nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrade.llm import decontaminate, exact, language, packing, simhash
from lexigrade.llm.common import cut, free_name, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Below it a document's predicted language is more likely wrong than right.
SCORE_FLOOR = 0.5


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """A written copy of `docs` with a number for each row: another scan of `docs` may number them otherwise."""
    row = free_name(docs, "row_in_stage")
    return cut(docs.withColumn(row, F.monotonically_increasing_id()), "zstd"), row


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that name their language and rejects those that it can't place.

    A document goes if its text has no letter, or if its likeliest language has a calibrated
    probability under `SCORE_FLOOR` and isn't the one it names. Where no document names a
    language, nothing can be learned and all with a letter stay. Text of a language that no document
    names may still resemble a known one and pass: a probability is shared among known languages.
    """
    predicted, score = free_name(docs, "predicted_language"), free_name(docs, "predicted_score")
    model = language.fit(docs.select("text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs, model, (predicted, score), keep_text=True)
    placed = (F.col(score) >= SCORE_FLOOR) | (F.col(predicted).eqNullSafe(F.col("lang")))
    return found.where((F.col(predicted) != language.UNDETERMINED) & placed).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    rows, row = numbered(docs)
    dropped = exact.deduplicate(rows.select(row, "doc_id", "text"), row).where(~F.col("kept")).select(F.col("row").alias(row))
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the row with the smallest doc_id stays."""
    rows, row = numbered(docs)
    return rows.join(simhash.representatives(rows, row), row, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go, repeated rows alike; null and wordless texts have none and stay."""
    names = tuple(free_name(docs, name) for name in ("found_words", "found_spans", "found_items"))
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), names=names)
    return found.where(F.size(names[1]) == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; repeated rows are packed each, a null text as its closing id alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: Fitted models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
