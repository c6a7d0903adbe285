"""Text-shape features of a column, from a few of its values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colprism.fixed_values import (
    COUNT_FEATURES,
    FLAG_FEATURES,
    LIST_MAX_CHARS,
    SAMPLE_COUNT,
    SAMPLE_FEATURE_NAMES,
    SENTENCE_MIN_WORDS,
    VOTES_NEEDED,
)
from colprism.functions.numeric import text_or_nan
from colprism.functions.values import value_features
from colprism.operators.sampling import filled_samples


def sample_features(
    samples: DataFrame,
    n: int = SAMPLE_COUNT,
    *,
    spread: str = "column",
    null_as_text: bool = False,
    use_legacy_names: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per column of a (column, value) table: samples, flags, mean and deviation
    of the counts; ``keep`` names columns of ``samples`` that go along.

    A flag is true if at least three of the samples match.  ``spread="column"`` takes
    mean and population deviation over the samples of each column; ``"table"`` sums
    the counts of each column and writes mean and sample deviation of these sums over
    all columns into every row.  ``null_as_text`` measures a NULL sample as 'nan'.
    """
    if spread not in ("column", "table"):
        raise ValueError(f"spread must be 'column' or 'table', not {spread!r}")
    value = text_or_nan(F.col("value")) if null_as_text else F.col("value")
    measured = filled_samples(samples, n, keep).select("column", "i", "value", *keep, *value_features(value))

    votes = [
        (F.count_if(F.col(f)) >= VOTES_NEEDED).alias(f) for f in FLAG_FEATURES
    ]
    shown = [F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"sample_{i}") for i in range(n)]
    shown += [F.max(k).alias(k) for k in keep]
    if spread == "column":
        spreads = [
            e
            for c in COUNT_FEATURES
            for e in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))
        ]
        per_column = measured.groupBy("column").agg(*shown, *votes, *spreads)
    else:
        totals = measured.groupBy("column").agg(*shown, *votes, *[F.sum(c).alias(c) for c in COUNT_FEATURES])
        # One row per column of the profiled table: bounded by its schema.
        table = Window.partitionBy(F.lit(1))
        per_column = totals.select(
            "column",
            *keep,
            *[f"sample_{i}" for i in range(n)],
            *FLAG_FEATURES,
            *[
                e
                for c in COUNT_FEATURES
                for e in (
                    F.avg(c).over(table).alias(f"mean_{c}"),
                    F.stddev_samp(c).over(table).alias(f"std_{c}"),
                )
            ],
        )
    result = per_column.withColumns(
        {
            "is_list": F.col("is_delimited")
            & F.coalesce(F.col("mean_char_count") < LIST_MAX_CHARS, F.lit(False)),
            "is_long_sentence": F.coalesce(
                F.col("mean_word_count") > SENTENCE_MIN_WORDS, F.lit(False)
            ),
        }
    )
    names = feature_names(n)
    return result.select(
        "column", *keep, *[F.col(k).alias(v if use_legacy_names else k) for k, v in names.items()]
    )


def feature_names(n: int = SAMPLE_COUNT) -> dict[str, str]:
    """Output names for ``n`` samples, new -> legacy, in order."""
    shown = {f"sample_{i}": f"sample_{i + 1}" for i in range(n)}
    rest = {k: v for k, v in SAMPLE_FEATURE_NAMES.items() if not k.startswith("sample_")}
    return shown | rest
