"""The level scale and the columns built from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordered scale (position = numeric weight) and the label of
# anything that cannot be placed on it.
LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2")
UNKNOWN = "Unknown"


def level_array(levels=LEVELS) -> Column:
    return F.array(*[F.lit(level) for level in levels])


def level_at(index: Column, levels=LEVELS) -> Column:
    """Level name at a zero-based index; NULL stays NULL."""
    return F.get(level_array(levels), index.cast("int"))


def level_index(level: Column, levels=LEVELS) -> Column:
    """Zero-based weight of a level name; NULL when it is off the scale."""
    position = F.array_position(level_array(levels), level)
    return F.when(position > 0, position - 1).cast("int")
