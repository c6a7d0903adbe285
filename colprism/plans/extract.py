"""The whole feature row of every column of a table, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprism.fixed_values import FLAG_FEATURES, PROFILE_NAMES, SAMPLE_COUNT
from colprism.operators.longform import chosen_fields
from colprism.operators.profile import profile, statistics_rows, with_percents
from colprism.operators.samplefeatures import feature_names, sample_features
from colprism.operators.sampling import counts_and_samples, sample_rows


def extract_features(
    df: DataFrame,
    *,
    columns: Sequence[str] | None = None,
    semantics: str = "spark",
    spread: str = "column",
    distinct: str = "exact",
    n: int = SAMPLE_COUNT,
    keep_null: bool = False,
    order_by: str | None = None,
    use_legacy_names: bool = False,
) -> DataFrame:
    """Statistics, samples and text features, one row per column.

    The result is lazy; write it with ``df.write.parquet``.
    """
    names = list(df.columns if columns is None else columns)
    together = distinct == "exact" and order_by is None and n >= 1
    if together:  # counts and samples of different cells share a shuffle: three scans in all
        samples = counts_and_samples(df, n, names, semantics=semantics, keep_null=keep_null)
        stats = statistics_rows(df, chosen_fields(df, names), semantics)
    else:
        samples = sample_rows(df, n, names, keep_null=keep_null, order_by=order_by)
        stats = profile(df, names, semantics=semantics, distinct=distinct)
    text = sample_features(
        samples,
        n,
        spread=spread,
        null_as_text=keep_null and semantics == "pandas",
        keep=["distinct"] if together else [],
    ).withColumnRenamed("column", "name")
    # Both sides have one row per column, so the broadcast is bounded by the schema.
    joined = stats.join(F.broadcast(text), "name", "left").fillna(
        False, subset=[*FLAG_FEATURES, "is_list", "is_long_sentence"]
    )
    if together:
        joined = with_percents(joined.fillna(0, subset=["distinct"]))
    renamed = PROFILE_NAMES | feature_names(n)
    return joined.select(
        *[F.col(k).alias(v if use_legacy_names else k) for k, v in renamed.items()]
    )


def featurize_table(
    df: DataFrame, *, order_by: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """The labelled-data layout: pandas semantics, legacy names, first-seen samples
    when ``order_by`` names a unique column."""
    return extract_features(
        df, columns=columns, semantics="pandas", order_by=order_by, use_legacy_names=True
    )
