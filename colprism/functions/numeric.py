"""Clipping and repair of numbers."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.fixed_values import KNN_CLIP, STATS_CLIP


def clip(c: Column, limit: float) -> Column:
    """Into [-limit, limit].  NULL and NaN pass through."""
    bounded = F.greatest(F.least(c, F.lit(limit)), F.lit(-limit))
    # Spark orders NaN above every number, so least() alone would turn it into the limit.
    return F.when(c.isNull() | F.isnan(c.cast("double")), c).otherwise(bounded)


def abs_limit_1000(c: Column, dtype: T.DataType | None = None) -> Column:
    return c if isinstance(dtype, T.BooleanType) else clip(c, float(KNN_CLIP))


def abs_limit_10000(c: Column, dtype: T.DataType | None = None) -> Column:
    return c if isinstance(dtype, T.BooleanType) else clip(c, float(STATS_CLIP))


def finite(c: Column) -> Column:
    """NaN becomes 0, an infinity the largest double of its sign."""
    top = sys.float_info.max
    d = c.cast("double")
    return (
        F.when(F.isnan(d), F.lit(0.0))
        .when(d == F.lit(float("inf")), F.lit(top))
        .when(d == F.lit(float("-inf")), F.lit(-top))
        .otherwise(d)
    )


def text_or_nan(c: Column) -> Column:
    """The cell as text; a missing cell as the text 'nan'."""
    return F.coalesce(c.cast("string"), F.lit("nan"))
