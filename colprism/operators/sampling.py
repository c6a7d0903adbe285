"""A few different values of every column, the same ones on every run.

Finding the n first different values of a column does not need all its different
values in one place.  A first pass keeps the smallest rank in each of a fixed number of
hash buckets; the n-th smallest of these belongs to n different values, so no value of
the answer can rank behind it.  A second pass keeps only cells up to that rank: a handful
per column, however large the table.  Both passes combine before they shuffle, so
repeated values and hot columns cost nothing extra.

The bound may come from any part of the values.  For the MD5 order the first pass looks
at one value in 64, picked by a cheap hash, and columns too poor in values for a
bound are simply made distinct.  So MD5 is computed about once per cell of the rich
columns and hardly at all elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.fixed_values import SAMPLE_COUNT
from colprism.functions.cells import any_hash, as_text, distinct_key, is_floating, is_word, quoted
from colprism.operators.longform import chosen_fields, explode_cells

_BUCKETS = 256
_ONE_IN = 64
_HEX_DIGITS = 15


def order_hash(column: Column, value: Column) -> Column:
    """Order of the reproducible sample: MD5 of ``column|value``."""
    return F.md5(F.concat(column, F.lit("|"), F.coalesce(value, F.lit(""))).cast("binary"))


def _leading_bits(hex_hash: Column) -> Column:
    """The first 60 bits as a number: same order as the text, and fixed width, so that
    minima are kept in a hash aggregate instead of a sort."""
    return F.conv(F.substring(hex_hash, 1, _HEX_DIGITS), 16, 10).cast("bigint")


def _cells(
    df: DataFrame,
    fields: list[T.StructField],
    keep_null: bool,
    order: Column | None,
    only: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(pos, column, hashed, value[, rank]); ``only`` limits the cells by their hash before
    any is turned into text."""

    def parts(c: Column, f: T.StructField) -> dict[str, Column]:
        hashed = any_hash(c, f.dataType)
        text = as_text(c, f.dataType)
        if keep_null and is_floating(f.dataType):
            text = F.when(~F.isnan(c), text)
        return {
            "column": F.lit(f.name),
            "hashed": hashed,
            "value": text if only is None else F.when(only(hashed), text),
        }

    keep = [] if order is None else [order.alias("rank")]
    cells = explode_cells(df, fields, parts, keep)
    if not keep_null or only is not None:
        cells = cells.where(F.col("value").isNotNull())
    return cells


def _rank_bounds(ranked: DataFrame, n: int) -> DataFrame:
    """(pos, bound): the n-th smallest bucket minimum, NULL with fewer buckets.  One row
    per column of the table."""
    bucket = F.pmod(F.shiftright("hashed", 6), F.lit(_BUCKETS)).alias("bucket")
    return (
        ranked.groupBy("pos", bucket)
        .agg(F.min("rank").alias("low"))
        .groupBy("pos")
        .agg(F.get(F.sort_array(F.collect_list("low")), F.lit(n - 1)).alias("bound"))
    )


def _hash_of_cell() -> Column:
    return order_hash(F.col("column"), F.col("value"))


def _near_by_hash(df: DataFrame, fields: list[T.StructField], n: int, keep_null: bool) -> DataFrame:
    """(pos, column, value) up to the MD5 bound of each column, made distinct."""
    some = _cells(df, fields, keep_null, None, lambda h: F.pmod(h, F.lit(_ONE_IN)) == 0)
    bounds = _rank_bounds(some.withColumn("rank", _leading_bits(_hash_of_cell())), n).select(
        "pos", F.lpad(F.lower(F.hex("bound")), _HEX_DIGITS, "0").alias("bound")
    )
    near = (
        _cells(df, fields, keep_null, None)
        # At most one row per column: the broadcast is bounded by the schema.
        .join(F.broadcast(bounds), "pos", "left")
        .where(
            F.when(F.col("bound").isNull(), F.lit(True)).otherwise(
                F.substring(_hash_of_cell(), 1, _HEX_DIGITS) <= F.col("bound")
            )
        )
    )
    return near.select("pos", "column", "value").distinct().withColumn("rank", F.lit(0))


def _near_by_order(
    df: DataFrame, fields: list[T.StructField], n: int, keep_null: bool, order: Column
) -> DataFrame:
    """(pos, column, value, rank): first position of the values seen up to the bound."""
    cells = _cells(df, fields, keep_null, order)
    bounds = _rank_bounds(cells, n)
    return (
        # At most one row per column: the broadcast is bounded by the schema.
        cells.join(F.broadcast(bounds), "pos", "left")
        .where(F.col("bound").isNull() | (F.col("rank") <= F.col("bound")))
        .groupBy("pos", "column", "value")
        .agg(F.min("rank").alias("rank"))
    )


def _counted_and_bounded(df: DataFrame, fields: list[T.StructField], n: int, semantics: str) -> DataFrame:
    """(pos, distinct, bound): the exact number of different cells and the MD5 bound of each column, by one shuffle.

    The different keys of all columns are one table.  One key in 64, picked by its hash,
    carries its text, and the bound comes from these.  A key has one text: zeros, which
    can be written with a sign, carry none.
    """

    def parts(c: Column, f: T.StructField) -> dict[str, Column]:
        counted = F.when(~F.isnan(c), c) if semantics == "pandas" and is_floating(f.dataType) else c
        key = distinct_key(counted, f.dataType)
        words = is_word(f.dataType)
        shown = F.pmod(key if words else F.xxhash64(key), F.lit(_ONE_IN)) == 0
        if is_floating(f.dataType):
            shown = shown & (c != 0)
        none = F.lit(None)
        return {
            "word": key if words else none.cast("bigint"),
            "short": none.cast("string") if words else key,
            "value": F.when(shown, as_text(c, f.dataType)),
        }

    names = F.array(*[F.lit(f.name) for f in fields])
    keys = explode_cells(df, fields, parts).distinct()
    hashed = F.coalesce("word", F.xxhash64("short"))
    bucket = F.when(F.col("value").isNotNull(), F.pmod(F.shiftright(hashed, 6), F.lit(_BUCKETS)))
    rank = _leading_bits(order_hash(F.get(names, F.col("pos")), F.col("value")))
    sums = keys.groupBy("pos", bucket.alias("bucket")).agg(
        F.count(F.coalesce("word", F.when(F.col("short").isNotNull(), F.lit(0)))).alias("n"),
        F.min(F.when(F.col("value").isNotNull(), rank)).alias("low"),
    )
    return sums.groupBy("pos").agg(
        F.sum("n").alias("distinct"), F.get(F.sort_array(F.collect_list("low")), F.lit(n - 1)).alias("bound")
    )


def counts_and_samples(
    df: DataFrame, n: int, columns: Sequence[str] | None = None, *, semantics: str = "spark", keep_null: bool = False
) -> DataFrame:
    """(column, value, rn, distinct): the samples of :func:`sample_rows`, each with the exact distinct count of its column.

    Two scans: one counts and bounds, one picks the samples.  A column without a value
    has no row.
    """
    fields = chosen_fields(df, columns)
    told = _counted_and_bounded(df, fields, n, semantics)
    bound = F.lpad(F.lower(F.hex("bound")), _HEX_DIGITS, "0")
    near = (
        _cells(df, fields, keep_null, None)
        # One row per column: the broadcast is bounded by the schema.
        .join(F.broadcast(told), "pos", "left")
        .where(F.col("bound").isNull() | (F.substring(_hash_of_cell(), 1, _HEX_DIGITS) <= bound))
    )
    near = near.select("pos", "column", "value", "distinct").distinct()
    in_order = Window.partitionBy("pos").orderBy(_hash_of_cell(), F.col("value").asc_nulls_first())
    return near.withColumn("rn", F.row_number().over(in_order)).where(F.col("rn") <= n).select("column", "value", "rn", "distinct")


def sample_rows(
    df: DataFrame,
    n: int = SAMPLE_COUNT,
    columns: Sequence[str] | None = None,
    *,
    keep_null: bool = False,
    order_by: str | None = None,
) -> DataFrame:
    """(column, value, rn): as :func:`sample_values`, with the rank of each value."""
    if n < 1:
        raise ValueError("n must be at least 1")
    fields = chosen_fields(df, columns)
    if order_by is None:
        near = _near_by_hash(df, fields, n, keep_null)
    else:
        near = _near_by_order(df, fields, n, keep_null, quoted(order_by))
    in_order = Window.partitionBy("pos").orderBy(
        "rank", _hash_of_cell(), F.col("value").asc_nulls_first()
    )
    return (
        near.withColumn("rn", F.row_number().over(in_order))
        .where(F.col("rn") <= n)
        .select("column", "value", "rn")
    )


def sample_values(
    df: DataFrame,
    n: int = SAMPLE_COUNT,
    columns: Sequence[str] | None = None,
    *,
    keep_null: bool = False,
    order_by: str | None = None,
) -> DataFrame:
    """(column, value): up to ``n`` different values of every column.

    By default the values whose MD5 together with the column name is smallest.  With
    ``order_by`` (a unique column of the table) the values that appear first in that
    order.  ``keep_null=True`` counts NULL as one more value.
    """
    return sample_rows(df, n, columns, keep_null=keep_null, order_by=order_by).select(
        "column", "value"
    )


def fill_up(values: Column, n: int) -> Column:
    """An array of exactly ``n`` items: the first n, or the items repeated in turn."""
    return F.when(
        F.size(values) > 0,
        F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: F.element_at(values, (i % F.size(values) + 1).cast("int")),
        ),
    ).otherwise(values)


def filled_samples(samples: DataFrame, n: int = SAMPLE_COUNT, keep: Sequence[str] = ()) -> DataFrame:
    """(column, i, value): exactly ``n`` values per column, from (column, value[, rn]); ``keep`` goes along."""
    return ranked_samples(samples, n, keep).select(
        "column", *keep, F.posexplode(fill_up(F.col("listed"), n)).alias("i", "value")
    )


def ranked_samples(samples: DataFrame, n: int, keep: Sequence[str] = ()) -> DataFrame:
    """(column, listed): at most ``n`` values per column as an array, in sample order.

    The row number cuts every group to ``n`` before anything is collected.  ``keep``
    names columns that are the same in all rows of a column.
    """
    order = [order_hash(F.col("column"), F.col("value")), F.col("value").asc_nulls_first()]
    if "rn" in samples.columns:
        order = [F.col("rn"), *order]
    in_order = Window.partitionBy("column").orderBy(*order)
    ordered = F.sort_array(F.collect_list(F.struct("place", "value")))
    return (
        samples.withColumn("place", F.row_number().over(in_order))
        .where(F.col("place") <= n)
        .groupBy("column")
        .agg(F.transform(ordered, lambda s: s["value"]).alias("listed"), *[F.max(k).alias(k) for k in keep])
    )
