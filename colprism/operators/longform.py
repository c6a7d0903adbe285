"""Wide tables as (column, value) rows: one scan, however many columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.functions.cells import as_text, distinct_key, is_word, quoted


def chosen_fields(df: DataFrame, columns: Sequence[str] | None) -> list[T.StructField]:
    names = list(df.columns if columns is None else columns)
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"column names must be unique, these are not: {sorted(twice)}")
    fields = {f.name: f for f in df.schema.fields}
    unknown = [n for n in names if n not in fields]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return [fields[n] for n in names]


def explode_cells(
    df: DataFrame,
    fields: list[T.StructField],
    parts: Callable[[Column, T.StructField], dict[str, Column]],
    keep: Sequence[Column] = (),
) -> DataFrame:
    """One row per cell: ``pos`` (index into ``fields``) and the given parts.

    ``inline`` over an array of structs reads the table once; a union of one select
    per column would scan it once per column.  ``pos`` instead of the name keeps the
    rows that get shuffled small.
    """
    if not fields:
        raise ValueError("at least one column is needed")
    rows = [
        F.struct(
            F.lit(pos).alias("pos"),
            *[e.alias(k) for k, e in parts(quoted(f.name), f).items()],
        )
        for pos, f in enumerate(fields)
    ]
    return df.select(*keep, F.inline(F.array(*rows)))


def melt(df: DataFrame, columns: Sequence[str] | None = None, keep_null: bool = True) -> DataFrame:
    """(column, value) with every value as text."""
    fields = chosen_fields(df, columns)
    long = explode_cells(
        df, fields, lambda c, f: {"column": F.lit(f.name), "value": as_text(c, f.dataType)}
    ).select("column", "value")
    return long if keep_null else long.where(F.col("value").isNotNull())


def key_cells(df: DataFrame, fields: list[T.StructField], words: bool) -> DataFrame | None:
    """(pos, key): the distinct-count key of every cell, NULL for NULL.

    Columns of fixed width (``words``) and text columns are separate tables, because
    their keys differ in type.  On columnar files they read disjoint columns.
    """
    chosen = [(i, f) for i, f in enumerate(fields) if is_word(f.dataType) == words]
    if not chosen:
        return None
    rows = [
        F.struct(F.lit(i).alias("pos"), distinct_key(quoted(f.name), f.dataType).alias("key"))
        for i, f in chosen
    ]
    return df.select(F.inline(F.array(*rows)))
