"""Reproducible shuffles, folds and hold-outs.

Everything hangs on the MD5 of seed and id, so a row stays where it is when other rows come
and go, when a task is run again and on any number of executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colprism.fixed_values import FOLDS, HOLDOUT_SHARE, SEED
from colprism.functions.cells import quoted


def shuffle_hash(row_id: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), row_id.cast("string")).cast("binary"))


def seeded_shuffle(df: DataFrame, row_id: str, seed: int = SEED) -> DataFrame:
    return df.orderBy(shuffle_hash(quoted(row_id), seed), quoted(row_id))


def number_rows(
    df: DataFrame, prefix: Column, order: Sequence[Column], name: str, total: str | None = None
) -> DataFrame:
    """Row numbers 0, 1, ... over the whole table without sorting it in one task.

    ``prefix`` must be a leading part of the order with a bounded number of values
    (say, four hex digits).  Rows are numbered inside each prefix in parallel; the
    start of each prefix comes from the table of prefix sizes.
    """
    keyed = df.withColumn("__prefix", prefix)
    before = Window.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("__prefix").agg(F.count(F.lit(1)).alias("__size"))
    starts = starts.select(
        "__prefix",
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"),
        F.sum("__size").over(Window.partitionBy(F.lit(1))).alias("__total"),
    )
    inside = Window.partitionBy("__prefix").orderBy(*order)
    numbered = keyed.join(F.broadcast(starts), "__prefix").withColumn(
        name, F.col("__start") + F.row_number().over(inside) - 1
    )
    if total is not None:
        numbered = numbered.withColumn(total, F.col("__total"))
    return numbered.drop("__prefix", "__start", "__total")


def kfold(
    df: DataFrame, row_id: str, folds: int = FOLDS, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """Contiguous folds 0..folds-1 of the shuffled rows; the first ``n mod folds`` folds
    have one row more.  ``row_id`` must be unique."""
    hashed = shuffle_hash(quoted(row_id), seed)
    rows = number_rows(
        df, F.substring(hashed, 1, 4), [hashed, quoted(row_id)], "__row", "__rows"
    )
    size = F.expr(f"__rows div {folds}")
    longer = F.col("__rows") % folds
    in_longer = longer * (size + 1)
    # A fold size of 0 occurs only with fewer rows than folds; then all rows are in the
    # longer folds and the second branch is not taken.
    fold = F.when(
        F.col("__row") < in_longer, F.floor(F.col("__row") / (size + 1))
    ).otherwise(longer + F.floor(F.try_divide(F.col("__row") - in_longer, size)))
    return rows.withColumn(name, fold.cast("int")).drop("__row", "__rows")


def hash_fold(
    df: DataFrame, row_id: str, folds: int = FOLDS, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """Folds of nearly equal size without any shuffle; equal ids share a fold."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), quoted(row_id)), F.lit(folds)).cast("int"))


def in_holdout(row_id: Column, share: float = HOLDOUT_SHARE, seed: int = SEED) -> Column:
    """Whether a row is in the hold-out: its hash is in the lowest ``share`` of all."""
    if not 0 < share < 1:
        raise ValueError("share must be between 0 and 1")
    edge = format(int(share * 2**32), "08x")
    return F.substring(shuffle_hash(row_id, seed), 1, 8) < F.lit(edge)


def holdout_split(
    df: DataFrame, row_id: str, share: float = HOLDOUT_SHARE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """(rest, hold-out)."""
    test = in_holdout(quoted(row_id), share, seed)
    return df.where(~test), df.where(test)
