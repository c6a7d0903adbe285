"""Preparing column statistics for a model: choose, fill, clip, scale, encode labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.fixed_values import LABEL_CODES, STATS_19, STATS_19_SCALED, STATS_25
from colprism.functions.cells import quoted
from colprism.functions.numeric import abs_limit_10000, finite

ClipFn = Callable[[Column, T.DataType], Column]


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation of some columns; a constant column keeps scale 1."""

    means: dict[str, float]
    scales: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scaler:
        """One aggregate over the table; only its single row reaches the driver."""
        aggs = []
        for i, c in enumerate(columns):
            x = finite(quoted(c))
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
        row = df.agg(*aggs).first()
        return cls(
            {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(columns)},
            {c: float(row[f"s{i}"] or 1.0) for i, c in enumerate(columns)},
        )

    def scaled(self, column: str) -> Column:
        x = finite(quoted(column))
        return ((x - F.lit(self.means[column])) / F.lit(self.scales[column])).alias(column)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(
            *[self.scaled(c) if c in self.means else quoted(c) for c in df.columns]
        )


def fill_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL and NaN become 0, a NULL flag becomes false."""
    flags = [c for c in columns if isinstance(df.schema[c].dataType, T.BooleanType)]
    numbers = [c for c in columns if c not in flags]
    if numbers:
        df = df.fillna(0, subset=numbers)
    return df.fillna(False, subset=flags) if flags else df


def clip_columns(df: DataFrame, columns: Sequence[str], limit: ClipFn) -> DataFrame:
    return df.select(
        *[
            limit(quoted(c), df.schema[c].dataType).alias(c) if c in columns else quoted(c)
            for c in df.columns
        ]
    )


def _fit_and_scale(
    df: DataFrame, columns: Sequence[str], scaler: Scaler | None
) -> tuple[DataFrame, Scaler]:
    scaler = scaler or Scaler.fit(df, columns)
    return scaler.transform(df), scaler


def process_stats(
    df: DataFrame,
    *,
    normalize: bool,
    abs_limit: ClipFn | None = None,
    scaler: Scaler | None = None,
    columns: Sequence[str] = STATS_25,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The statistics in fixed order, filled; with ``normalize`` also clipped and scaled.

    Without ``scaler`` the scaling is fitted on this very table; pass the scaler of the
    training table (:func:`stats_scaler`) to scale a test table alike.  ``keep`` names
    further columns to carry along.
    """
    filled = _chosen_stats(df, columns, keep, abs_limit if normalize else None)
    if not normalize:
        return filled
    return _fit_and_scale(filled, columns, scaler)[0]


def stats_scaler(
    df: DataFrame, *, abs_limit: ClipFn | None = None, columns: Sequence[str] = STATS_25
) -> Scaler:
    """The scaler that :func:`process_stats` fits on this table."""
    return Scaler.fit(_chosen_stats(df, columns, (), abs_limit), columns)


def _chosen_stats(
    df: DataFrame, columns: Sequence[str], keep: Sequence[str], abs_limit: ClipFn | None
) -> DataFrame:
    chosen = df.select(*[quoted(c) for c in (*keep, *columns)])
    filled = fill_missing(chosen, columns)
    return filled if abs_limit is None else clip_columns(filled, columns, abs_limit)


def process_statistics(
    df: DataFrame,
    *,
    abs_limit: ClipFn = abs_limit_10000,
    scaler: Scaler | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The 19 statistics of the sequence model under their model names, seven of them
    clipped and scaled."""
    prepared = _model_statistics(df, abs_limit, keep)
    return _fit_and_scale(prepared, STATS_19_SCALED, scaler)[0]


def statistics_scaler(df: DataFrame, *, abs_limit: ClipFn = abs_limit_10000) -> Scaler:
    """The scaler that :func:`process_statistics` fits on this table."""
    return Scaler.fit(_model_statistics(df, abs_limit, ()), STATS_19_SCALED)


def _model_statistics(df: DataFrame, abs_limit: ClipFn, keep: Sequence[str]) -> DataFrame:
    renamed = df.select(
        *[quoted(c) for c in keep], *[quoted(c).alias(m) for c, m in STATS_19.items()]
    )
    filled = fill_missing(renamed, list(STATS_19.values()))
    return clip_columns(filled, STATS_19_SCALED, abs_limit)


def label_code(label: Column, codes: dict[str, int] = LABEL_CODES) -> Column:
    """The code of a label, NULL for an unknown one."""
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), label)


def process_targets(
    df: DataFrame, column: str = "y_act", codes: dict[str, int] = LABEL_CODES
) -> DataFrame:
    return df.withColumn(column, label_code(quoted(column), codes).cast("double"))
