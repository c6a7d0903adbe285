"""Scores of predictions, folds, grids and timing trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colprism.functions.cells import quoted


def argmax(scores: Column) -> Column:
    """Position of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def hit_rate(actual: Column, predicted: Column) -> Column:
    return F.avg((actual == predicted).cast("int"))


def accuracy(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(hit_rate(quoted(actual), quoted(predicted)).alias("accuracy"))


def confusion_matrix(
    df: DataFrame, actual: str, predicted: str, classes: Sequence[int]
) -> DataFrame:
    """One row per actual class, one column ``predicted_<class>`` per predicted class.

    One global aggregate of fixed size, so classes that never occur have a row of zeros.
    """
    a, p = quoted(actual), quoted(predicted)
    cells = [F.count_if((a == x) & (p == y)).alias(f"{x}_{y}") for x in classes for y in classes]
    rows = [
        F.struct(
            F.lit(x).alias("actual"),
            *[F.col(f"`{x}_{y}`").alias(f"predicted_{y}") for y in classes],
        )
        for x in classes
    ]
    return df.agg(*cells).select(F.inline(F.array(*rows)))


def fold_averages(scores: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return scores.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def best_of_grid(
    scores: DataFrame, by: Sequence[str], score: str, grid_order: Sequence[str]
) -> DataFrame:
    """The best grid point per group; the earliest one in grid order among equals."""
    place = Window.partitionBy(*by).orderBy(F.col(score).desc(), *grid_order)
    return (
        scores.withColumn("__place", F.row_number().over(place))
        .where(F.col("__place") == 1)
        .drop("__place")
    )


def winner_counts(best: DataFrame, parameter: str) -> DataFrame:
    """How often each value of a parameter won."""
    return best.groupBy(parameter).agg(F.count(F.lit(1)).alias("wins"))


def with_total(trials: DataFrame) -> DataFrame:
    return trials.withColumn("total", F.col("prepare") + F.col("run"))


def trial_summary(trials: DataFrame) -> DataFrame:
    """Seconds per iteration of every experiment, from (name, prepare, run, iterations)."""
    per = F.sum("iterations")
    return (
        with_total(trials)
        .groupBy("name")
        .agg(*[F.try_divide(F.sum(c), per).alias(c) for c in ("prepare", "run", "total")])
    )
