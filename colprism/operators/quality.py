"""Rows with broken characters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprism.fixed_values import TEXT_COLUMNS, UNPRINTABLE_PATTERN
from colprism.functions.cells import quoted


def bad_row(columns: Sequence[str] = TEXT_COLUMNS) -> Column:
    """Whether any of the columns has a character that is not printable ASCII."""
    tests = [F.coalesce(quoted(c), F.lit("")).rlike(UNPRINTABLE_PATTERN) for c in columns]
    return reduce(Column.__or__, tests)


def find_bad_rows(
    df: DataFrame, columns: Sequence[str] = TEXT_COLUMNS, name: str = "is_bad"
) -> DataFrame:
    return df.withColumn(name, bad_row(columns))


def drop_bad_rows(df: DataFrame, columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    return df.where(~bad_row(columns))
