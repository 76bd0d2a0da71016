"""Readers, writers and the cleaning each input table gets.

Every reader takes a declared schema; nothing is inferred. A frame from any other source
(parquet, a table) goes through the same cleaning functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrade.functions.text import strip
from lexigrade.levels import LEVELS

# Column names of the input tables.
TEXT_EN, TEXT_RU, LABEL = "text_en", "text_ru", "label"
SILVER_COLUMNS = ("kaz_item", "rus_item", "cefr", "kaz_sent", "rus_sent")
TABULAR_TEXT = ("kaz", "rus")
TABULAR_NUMERIC = (
    "difficulty_score",
    "avg_sent_len_mean",
    "avg_word_len_mean",
    "ttr_mean",
    "long_ratio_mean",
    "align_diff",
    "words_mean",
)
TABULAR_TARGET, TABULAR_TARGET_INDEX = "predicted_cefr", "predicted_cefr_int"


def read_csv(
    spark: SparkSession, path: str, columns: dict[str, str], multiline: bool = False
) -> DataFrame:
    """CSV with a header. `columns` names the types of the wanted columns.

    Wanted columns absent from the header are simply not in the result, so that the cleaning
    functions can report or fill them. Every file is checked against the header: one with
    other columns, or the same in another order, stops the job instead of being misread.
    Files are split over tasks; with `multiline` quoted line breaks are honoured and a file
    is one task.
    """
    options = {"header": True, "multiLine": multiline, "escape": '"'}
    header = spark.read.options(**options).csv(path).columns
    ddl = ", ".join(f"`{name}` {columns.get(name, 'string')}" for name in header)
    frame = spark.read.options(**options, enforceSchema=False).schema(ddl).csv(path)
    return frame.select(*[F.col(f"`{name}`") for name in columns if name in header])


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def _text_or_empty(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def parallel_corpus(raw: DataFrame) -> DataFrame:
    """(pair_id, kaz, rus): both sides trimmed; missing column or value reads as ''."""
    return raw.select(
        "pair_id",
        *[strip(_text_or_empty(raw, side)).alias(side) for side in ("kaz", "rus")],
        *[c for c in raw.columns if c not in ("pair_id", "kaz", "rus")],
    )


def first_pairs(pairs: DataFrame, size: int | None) -> DataFrame:
    """The first `size` pairs by id; all of them for None."""
    return pairs if size is None else pairs.orderBy("pair_id").limit(size)


def ingest_bitext(raw: DataFrame) -> DataFrame:
    """(kk, ru) → (kaz, rus): both non-empty as given, line breaks to spaces, trimmed."""
    flat = {s: strip(F.replace(F.col(s), F.lit("\n"), F.lit(" "))) for s in ("kk", "ru")}
    return raw.where((F.length("kk") > 0) & (F.length("ru") > 0)).select(
        *[c for c in raw.columns if c not in ("kk", "ru")],
        flat["kk"].alias("kaz"),
        flat["ru"].alias("rus"),
    )


def write_counted(df: DataFrame, path: str, form: str = "parquet") -> int:
    """Write and return the number of rows, counted while writing."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = counted.write.mode("overwrite")
    if form == "csv":
        writer.options(header=True, escape='"').csv(path)
    else:
        writer.format(form).save(path)
    return seen.get["rows"]


def text_corpus(raw: DataFrame, *, english: bool = True, russian: bool = True) -> DataFrame:
    """Labelled texts: label required, absent or missing texts read as ''."""
    require_columns(
        raw, [LABEL, *([TEXT_EN] if english else []), *([TEXT_RU] if russian else [])]
    )
    others = [c for c in raw.columns if c not in (TEXT_EN, TEXT_RU)]
    return raw.where(F.col(LABEL).isNotNull()).select(
        *others, *[_text_or_empty(raw, c).alias(c) for c in (TEXT_EN, TEXT_RU)]
    )


def text_columns(english: bool, russian: bool) -> list[str]:
    """Language columns that take part in training."""
    chosen = [*([TEXT_EN] if english else []), *([TEXT_RU] if russian else [])]
    if not chosen:
        raise ValueError("at least one language has to be included")
    return chosen


def tabular_corpus(raw: DataFrame) -> DataFrame:
    """Texts with numeric columns: target required, the numeric target is dropped."""
    require_columns(raw, [*TABULAR_TEXT, TABULAR_TARGET])
    others = [c for c in raw.columns if c not in (*TABULAR_TEXT, TABULAR_TARGET_INDEX)]
    return raw.where(F.col(TABULAR_TARGET).isNotNull()).select(
        *others, *[_text_or_empty(raw, c).alias(c) for c in TABULAR_TEXT]
    )


def word_labels(
    raw: DataFrame, text_col: str = "rus_item", label_col: str = "cefr"
) -> DataFrame:
    """(…, text, label): trimmed non-empty words with an upper-cased level of the scale."""
    require_columns(raw, [text_col, label_col])
    others = [c for c in raw.columns if c not in (text_col, label_col, *SILVER_COLUMNS)]
    return raw.select(
        *others,
        strip(F.col(text_col)).alias("text"),
        F.upper(F.col(label_col)).alias("label"),
    ).where((F.col("text") != "") & F.col("label").isin(*LEVELS))


def write_json(df: DataFrame, path: str) -> None:
    """Metrics as JSON lines."""
    df.write.mode("overwrite").json(path)
