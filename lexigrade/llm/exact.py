"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its content says so, chunks become verified identifiers, and texts are
equal when their ordered lists of identifiers are. A text is read by one scan and never
shuffled; only identifiers travel, a few bytes for each kilobyte of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrade.llm.common import cut, lower_ascii

#: Code points in a chunk at least and at most, and the ends that may close one in between.
SHORTEST, LONGEST = 512, 8192
ENDS = r"[\n.!?;,|][\s]|[aeiou][\s][^aeiou]"


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST, ends: str = ENDS) -> Column:
    """The text in order, cut after the first of `ends` past `shortest` code points; the empty text has none."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{shortest},{longest}}}?(?:{ends})|.{{1,{longest}}}"), F.lit(0))


def recipes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One row per row of `docs`: row, doc_id, text_sha256, chunks as (key, check), written once.

    `key` is a 64-bit hash and `check` the SHA-256 of the chunk. Rows are numbered here unless
    the column `row` has their numbers.
    """
    number = F.monotonically_increasing_id() if row is None else F.col("row")
    given = [] if row is None else [docs[row].alias("row")]
    read = docs.select(docs["doc_id"], lower_ascii(docs["text"]).alias("text"), *given)
    digest = F.transform(
        chunks(F.col("text")), lambda c: F.struct(F.xxhash64(c).alias("key"), F.unhex(F.sha2(c, 256)).alias("check"))
    )
    return cut(
        read.select(
            number.alias("row"),
            "doc_id",
            F.sha2(F.col("text"), 256).alias("text_sha256"),
            digest.alias("chunks"),
        )
    )


def identifiers(occurrences: DataFrame) -> DataFrame:
    """Distinct chunks: (key, check) -> number within the key, 1 unless two contents share a key."""
    distinct = occurrences.groupBy("key", "check").agg(F.count("*").alias("_n"))
    return distinct.select("key", "check", F.row_number().over(Window.partitionBy("key").orderBy("check")).alias("nth"))


def deduplicate(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Groups of equal texts (identical after lower-casing A-Z): one row per row of `docs`.

    Columns: row, doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the row with
    the largest doc_id stays; of repeated rows with that id the first in input order; a null
    id is smaller than any. Null text counts as empty, and empty texts are a group. Any other
    column is ignored. An empty table gives no rows. Chunks and groups of any size are summed
    before they are shuffled, and joined back by joins that Spark can split. `row` names a
    column of unique ascending numbers to use for `row`; a caller that joins the result to `docs`
    needs it, and reads it from a written copy.
    """
    written = recipes(docs, row)
    occurrences = written.select("row", F.posexplode("chunks").alias("pos", "chunk")).select(
        "row", "pos", "chunk.key", "chunk.check"
    )
    known = cut(identifiers(occurrences))
    listed = (
        occurrences.join(known, ["key", "check"])
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "key", "nth"))).alias("items"))
        .select("row", F.transform("items", lambda c: F.struct(c["key"].alias("key"), c["nth"].alias("nth"))).alias("recipe"))
    )
    empty = F.array().cast("array<struct<key:bigint,nth:int>>")
    with_recipe = cut(
        written.select("row", "doc_id", "text_sha256")
        .join(listed, "row", "left")
        .select("row", "doc_id", "text_sha256", F.coalesce("recipe", empty).alias("recipe"))
    )
    # Written, so that the join below has a shuffle on both sides and a crowded group can be split.
    groups = cut(
        with_recipe.groupBy("recipe").agg(
            F.count("*").alias("group_size"), F.max(F.struct("doc_id", (-F.col("row")).alias("turn"))).alias("best")
        )
    )
    return with_recipe.join(groups, "recipe").select(
        "row",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("best.turn")).alias("kept"),
        "text_sha256",
    )
