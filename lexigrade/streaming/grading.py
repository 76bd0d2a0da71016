"""The batch operators on a stream of texts.

Nothing here keeps state: text statistics work inside each row, and grading a micro-batch
is the batch plan applied to its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexigrade.functions.features import with_text_features


def stream_text_features(texts: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """Text statistics of a streaming frame; the same expressions as in batch."""
    return with_text_features(texts, text_col, prefix)


def grade_stream(
    texts: DataFrame, grade: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Apply a batch plan to every micro-batch of what has arrived, then stop.

    Each batch overwrites its own folder, so a batch that is run again after a failure
    leaves its rows once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        grade(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        texts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
