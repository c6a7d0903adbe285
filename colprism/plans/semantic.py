"""From a raw table to the semantic type of each of its columns, as one pipeline that can be saved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprism.fixed_values import LABEL_CODES, STATS_25, TEXT_COLUMNS, UNPRINTABLE_PATTERN
from colprism.operators.prep import label_code
from colprism.operators.quality import drop_bad_rows
from colprism.plans.classify import FeatureLayout, fit_features
from colprism.plans.extract import featurize_table

LABEL = "y_act"


class ColumnFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Changes the grain: a table goes in, one row of features per column comes out.

    The rows have the names and semantics of the labelled data (``featurize_table``).  A
    saved pipeline that begins with this stage takes raw tables.
    """

    orderBy = Param(Params._dummy(), "orderBy", "unique column whose order picks the samples, '' for the hash order", typeConverter=TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "columns to describe, none for all", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, orderBy: str = "", columns: Sequence[str] = ()):  # noqa: N803
        super().__init__()
        self._setDefault(orderBy="", columns=[])
        self._set(orderBy=orderBy, columns=list(columns))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = self.getOrDefault(self.columns) or None
        return featurize_table(dataset, order_by=self.getOrDefault(self.orderBy) or None, columns=columns)


def bad_row_filter(columns: Sequence[str] = TEXT_COLUMNS) -> SQLTransformer:
    """Rows with broken characters go, as a stage."""
    tests = " OR ".join(f"coalesce(`{c}`, '') RLIKE r'{UNPRINTABLE_PATTERN}'" for c in columns)
    return SQLTransformer(statement=f"SELECT * FROM __THIS__ WHERE NOT ({tests})")


def label_namer(codes: dict[str, int] = LABEL_CODES) -> SQLTransformer:
    """``predicted``: the name of the predicted code."""
    named = ", ".join(f"{code}, '{name}'" for name, code in codes.items())
    return SQLTransformer(statement=f"SELECT *, element_at(map({named}), cast(prediction AS int)) AS predicted FROM __THIS__")


def default_layout(samples: Sequence[str] = ("sample_1",)) -> FeatureLayout:
    """The 25 statistics, clipped and scaled, with bigrams of the name and of one sample."""
    return FeatureLayout(scaled=tuple(STATS_25), samples=tuple(samples))


def fit_types(
    labelled: DataFrame,
    estimator: Estimator,
    layout: FeatureLayout | None = None,
    *,
    label: str = LABEL,
    codes: dict[str, int] = LABEL_CODES,
    drop_bad: bool = True,
    features: ColumnFeatures | None = None,
) -> PipelineModel:
    """A pipeline from a raw table to (features, prediction, predicted), one row per column.

    ``labelled`` has one row of features per column, with its type by name in ``label``;
    rows with broken characters and unknown types teach nothing.  ``drop_bad`` says
    whether the pipeline drops such rows too; otherwise they get a type like any other.
    The estimator learns the codes from column ``label`` and needs no other setting.
    """
    train = drop_bad_rows(labelled) if drop_bad else labelled
    train = train.withColumn("label", label_code(F.col(label), codes).cast("double")).where("label IS NOT NULL")
    vectors = fit_features(train, layout or default_layout())
    model = estimator.fit(vectors.transform(train))
    first = [features or ColumnFeatures(), *([bad_row_filter()] if drop_bad else [])]
    return PipelineModel(stages=[*first, *vectors.stages, model, label_namer(codes)])


def predict_types(table: DataFrame, model: PipelineModel) -> DataFrame:
    """(Attribute_name, predicted) of every column of a raw table."""
    return model.transform(table).select("Attribute_name", "predicted")
