"""Registration of queries together with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _wide_integers(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.col(f.name).cast("bigint").alias(f.name)
            if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def register(name: str, sql: str | None = None):
    """Enter a query; integers come out as bigint, as in the checking SQL."""

    def enter(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: _wide_integers(build(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return build

    return enter


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def list_digest(column: Column | str) -> Column:
    """One value that stands for a whole list of strings."""
    return F.md5(F.array_join(column, "|").cast("binary"))
