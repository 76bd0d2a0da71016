"""Expressions over level distributions (`array<double>`, one entry per level)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrade.levels import LEVELS, UNKNOWN, level_array, level_at


def shares(counts: list[Column]) -> Column:
    """Counts per level → shares of their sum; all zero when the sum is zero."""
    known = sum(counts[1:], counts[0])
    return F.array(
        *[F.when(known > 0, c.cast("double") / known).otherwise(F.lit(0.0)) for c in counts]
    )


def average_level(distribution: Column, levels=LEVELS) -> Column:
    """Level at the mean index, halves rounded to even; `Unknown` for all zeros."""
    mean = F.lit(0.0)
    for i in range(len(levels)):
        mean = mean + F.lit(float(i)) * F.get(distribution, F.lit(i))
    has_mass = F.exists(distribution, lambda p: p > 0)
    return F.when(has_mass, level_at(F.rint(mean), levels)).otherwise(F.lit(UNKNOWN))


def share_of(distribution: Column, level: Column, levels=LEVELS) -> Column:
    """Share of a named level; zero for `Unknown` and off-scale names."""
    position = F.array_position(level_array(levels), level)
    return F.coalesce(F.get(distribution, (position - 1).cast("int")), F.lit(0.0))


def top_level(distribution: Column, levels=LEVELS) -> Column:
    """Most probable level, first one on ties; NULL for a missing or empty list."""
    position = F.array_position(distribution, F.array_max(distribution))
    return F.when(F.size(distribution) > 0, level_at(position - 1, levels))


def top_probability(distribution: Column) -> Column:
    return F.when(F.size(distribution) > 0, F.array_max(distribution)).otherwise(F.lit(0.0))


def softmax(scores: Column) -> Column:
    """Class scores → probabilities, shifted by the maximum against overflow."""
    powers = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda p: p / total)


def blend(model: Column, lexicon: Column, weight: float, levels=LEVELS) -> Column:
    """`weight * model + (1 - weight) * lexicon`, renormalised; uniform if all zero."""
    if not 0.0 <= weight <= 1.0:
        raise ValueError("weight must lie between 0 and 1")
    mixed = F.zip_with(
        model,
        lexicon,
        lambda m, k: F.lit(weight) * F.coalesce(m, F.lit(0.0))
        + F.lit(1.0 - weight) * F.coalesce(k, F.lit(0.0)),
    )
    total = F.aggregate(mixed, F.lit(0.0), lambda a, x: a + x)
    uniform = F.array(*[F.lit(1.0 / len(levels)) for _ in levels])
    return F.when(total > 0, F.transform(mixed, lambda p: p / total)).otherwise(uniform)
