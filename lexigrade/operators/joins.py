"""Dictionary look-ups that stay even when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrade.session import materialise

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
ROWS_PER_TASK = 1_000_000
TRACKED_KEYS = 100_000
HOT_KEYS = 10_000


def _cell_bytes(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        size = F.octet_length(column)
    elif isinstance(field.dataType, T.ArrayType) and isinstance(
        field.dataType.elementType, T.NumericType
    ):
        size = F.size(column) * 8
    elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        size = F.octet_length(F.to_json(column))
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(0)).cast("bigint")


def fits_broadcast(
    table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure the table (one aggregated row comes back) against the two bounds."""
    total = sum((_cell_bytes(f) for f in table.schema.fields), F.lit(0).cast("bigint"))
    measured = table.agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("b")).first()
    return measured["n"] <= max_rows and (measured["b"] or 0) <= max_bytes


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """Cut the lineage of a small aggregate, measure it, and hint only if it is small."""
    written = materialise(table)
    return F.broadcast(written) if fits_broadcast(written) else written


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    key: str,
    *,
    row_key: list[str],
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Left join with a table that holds each `key` at most once.

    The table is written once and measured from the copy. Found small it is broadcast, so
    `left` does not move. A larger one takes the salted way, where no key, however frequent,
    lands in one task.
    """
    table = materialise(table)
    if fits_broadcast(table, max_rows, max_bytes):
        columns = [*left.columns, *[c for c in table.columns if c != key]]
        return left.join(F.broadcast(table), key, "left").select(*columns)
    return salted_lookup(left, table, key, row_key=row_key, rows_per_task=rows_per_task)


def hot_keys(left: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(key, _parts): frequent keys and the number of tasks each one should fill.

    The frequent-item sketch keeps a fixed number of candidates per task and returns
    at most `HOT_KEYS` of them, so the result is bounded whatever the data. Which keys
    it picks affects only balance: any choice gives the same joined rows.
    """
    sketch = F.expr(f"approx_top_k(`{key}`, {HOT_KEYS}, {TRACKED_KEYS})")
    items = left.where(F.col(key).isNotNull()).agg(sketch.alias("items"))
    return (
        items.select(F.explode("items").alias("i"))
        .where(F.col("i.count") > rows_per_task)
        .select(
            F.col("i.item").alias(key),
            F.ceil(F.col("i.count") / F.lit(rows_per_task)).cast("int").alias("_parts"),
        )
    )


def salted_lookup(
    left: DataFrame,
    table: DataFrame,
    key: str,
    *,
    row_key: list[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Shuffled left join that spreads every frequent key over several tasks.

    The salt comes from the row's own identity, so a task that is run again puts each
    row in the same place.
    """
    columns = [*left.columns, *[c for c in table.columns if c != key]]
    left = materialise(left)  # read twice: for its hot keys and for the join
    hot = F.broadcast(materialise(hot_keys(left, key, rows_per_task)))
    identity = F.xxhash64(*[F.col(c) for c in row_key])
    # Rows without a key match nothing; they too are spread instead of meeting in the
    # task that owns NULL.
    spread = F.when(F.col(key).isNull(), F.lit(1 << 20)).otherwise(
        F.coalesce(F.col("_parts"), F.lit(1))
    )
    salted_left = left.join(hot, key, "left").select(
        *left.columns, F.pmod(identity, spread).cast("int").alias("_salt")
    )
    last = F.coalesce(F.col("_parts"), F.lit(1)) - 1
    salted_table = table.join(hot, key, "left").select(
        *table.columns, F.explode(F.sequence(F.lit(0), last)).alias("_salt")
    )
    return salted_left.join(salted_table, [key, "_salt"], "left").select(*columns)
