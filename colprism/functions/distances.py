"""Edit distance, Euclidean distance and their weighted sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def euclidean_distance(a: Column, b: Column) -> Column:
    """Of two arrays of doubles of equal length."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def euclidean_of(a: Column, b: Column, dims: int) -> Column:
    """As :func:`euclidean_distance` for a known length, without temporary arrays."""
    total = F.lit(0.0)
    for i in range(dims):
        gap = F.get(a, F.lit(i)) - F.get(b, F.lit(i))
        total = total + gap * gap
    return F.sqrt(total)


def edit_distance_up_to(a: Column, b: Column, limit: Column) -> Column:
    """The edit distance, or -1 if it is above ``limit``; only a band of the table is
    filled."""
    return F.call_function("levenshtein", a, b, limit)


def combined_distance(
    name_a: Column, stats_a: Column, name_b: Column, stats_b: Column, alpha: float
) -> Column:
    """``alpha * euclid + edit``: a sum of two metrics, hence a metric."""
    edit = edit_distance(name_a, name_b).cast("double")
    if alpha == 0:
        return edit
    return F.lit(float(alpha)) * euclidean_distance(stats_a, stats_b) + edit
