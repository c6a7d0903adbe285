"""Enlarged copies of a table for scaling tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprism.sources.tables import doublings


def replicate(df: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, by one generator.  Same rows as repeated self-unions,
    while the plan stays the same size and the table is scanned once."""
    if times < 1:
        raise ValueError("times must be at least 1")
    if times == 1:
        return df
    copies = F.explode(F.sequence(F.lit(1), F.lit(times)))
    return df.select("*", copies.alias("__copy")).drop("__copy")


def scaled(df: DataFrame, step: int) -> DataFrame:
    """The table at a step of the scaling series 1, 1, 2, 4, 8, 16, 32."""
    return replicate(df, doublings(step))
