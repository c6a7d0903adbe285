"""Classifiers over column statistics and character bigrams, built from Spark ML stages."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

import numpy as np
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    CountVectorizer,
    CountVectorizerModel,
    SQLTransformer,
    VectorAssembler,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.fixed_values import (
    FOLDS,
    FOREST_DEPTHS,
    FOREST_TREES,
    LOGISTIC_C,
    SEED,
    STATS_25,
    STATS_CLIP,
    SVM_C,
    SVM_GAMMA,
    TEXT_COLUMNS,
)
from colprism.functions.cells import quoted
from colprism.functions.chars import bigrams_sql
from colprism.functions.numeric import clip
from colprism.operators.evaluate import hit_rate
from colprism.operators.folds import in_holdout
from colprism.operators.prep import stats_scaler
from colprism.operators.quality import drop_bad_rows
from colprism.plans.forests import Forest, Models, fit_forests
from colprism.plans.gridfit import Machine, MachineModel, compact, fit_grid, grid_hits, prepared

_MAX_VOCABULARY = 1 << 18
_MAX_TREE_DEPTH = 30


@dataclass(frozen=True)
class FeatureLayout:
    """What goes into the feature vector."""

    stats: Sequence[str] = tuple(STATS_25)
    name: str | None = "Attribute_name"
    samples: Sequence[str] = ()
    scaled: Sequence[str] | None = None  # None: leave the statistics as they are
    limit: float = float(STATS_CLIP)


def _fitted_vocabulary(df: DataFrame, column: str) -> list[str]:
    grams = df.select(F.expr(bigrams_sql(column)).alias("grams"))
    fitted = CountVectorizer(
        inputCol="grams", outputCol="v", minDF=1.0, vocabSize=_MAX_VOCABULARY
    ).fit(grams)
    if len(fitted.vocabulary) >= _MAX_VOCABULARY:
        raise ValueError(
            f"{column} has {_MAX_VOCABULARY} or more different bigrams; "
            "use encoders.gram_vocabulary, which keeps them in a table"
        )
    return fitted.vocabulary


def fit_features(train: DataFrame, layout: FeatureLayout) -> PipelineModel:
    """Learn vocabularies and scaling; the result adds ``features`` to any such table.

    The sample vocabulary is learned on the first sample column and used for all of them.
    Only built-in stages are used, so the pipeline can be saved and loaded anywhere.
    """
    scaler, flags = None, set()
    if layout.scaled:
        flags = {f.name for f in train.schema.fields if isinstance(f.dataType, T.BooleanType)}
        scaler = stats_scaler(
            train,
            abs_limit=lambda c, t: c if isinstance(t, T.BooleanType) else clip(c, layout.limit),
            columns=layout.scaled,
        )
    pieces, inputs, stages = [], [], []
    for i, stat in enumerate(layout.stats):
        number = f"coalesce(nanvl(cast(`{stat}` AS double), 0D), 0D)"
        if scaler is not None and stat in scaler.means:
            if stat not in flags:
                number = f"greatest(least({number}, {layout.limit}D), -{layout.limit}D)"
            number = (
                f"({number} - cast('{scaler.means[stat]!r}' AS double))"
                f" / cast('{scaler.scales[stat]!r}' AS double)"
            )
        pieces.append(f"{number} AS __stat_{i}")
        inputs.append(f"__stat_{i}")
    texts = ([layout.name] if layout.name else []) + list(layout.samples)
    vocabulary = None
    for i, column in enumerate(texts):
        pieces.append(f"{bigrams_sql(column)} AS __grams_{i}")
        inputs.append(f"__counts_{i}")
        if vocabulary is None or i <= (1 if layout.name else 0):
            vocabulary = _fitted_vocabulary(train, column)
        stages.append(
            CountVectorizerModel.from_vocabulary(
                vocabulary, inputCol=f"__grams_{i}", outputCol=f"__counts_{i}"
            )
        )
    made = SQLTransformer(statement=f"SELECT *, {', '.join(pieces)} FROM __THIS__")
    joined = VectorAssembler(inputCols=inputs, outputCol="features")
    scratch = [f"__stat_{i}" for i in range(len(layout.stats))]
    scratch += [f"__{kind}_{i}" for i in range(len(texts)) for kind in ("grams", "counts")]
    tidy = SQLTransformer(
        statement=f"SELECT * EXCEPT ({', '.join(scratch)}) FROM __THIS__"
    )
    return PipelineModel(stages=[made, *stages, joined, tidy])


def logistic(c: float, rows: int, label: str = "label", iterations: int = 100) -> Estimator:
    """Multinomial logistic regression with an L2 penalty of strength 1/C."""
    return LogisticRegression(
        labelCol=label, family="multinomial", regParam=1.0 / (c * rows), elasticNetParam=0.0,
        standardization=False, maxIter=iterations,
    )


def forest(trees: int, depth: int, label: str = "label") -> Estimator:
    """Random forest.  Spark grows trees to depth 30 at most.

    The node of each row is kept: else every level sends all trees grown so far to every task.
    """
    return RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=min(depth, _MAX_TREE_DEPTH), seed=SEED, cacheNodeIds=True
    )


def linear_svm(c: float, rows: int, label: str = "label", iterations: int = 100) -> Estimator:
    """One linear support vector machine per class."""
    machine = LinearSVC(regParam=1.0 / (c * rows), standardization=False, maxIter=iterations)
    return OneVsRest(classifier=machine, labelCol=label)


def perceptron(
    inputs: int, classes: int, hidden: Sequence[int] = (100, 100), label: str = "label",
    iterations: int = 100,
) -> Estimator:
    """Feed-forward network over statistics and bigrams."""
    return MultilayerPerceptronClassifier(
        labelCol=label, layers=[inputs, *hidden, classes], seed=SEED, maxIter=iterations
    )


@dataclass(frozen=True)
class Candidate:
    """One grid point: its parameters, and an estimator for a given number of rows."""

    params: dict[str, float]
    estimator: Callable[[int], Estimator]
    machine: Machine | None = None  # what fits it together with the rest of the grid
    forest: Forest | None = None  # likewise


def logistic_grid(
    label: str = "label", values: Sequence[float] = LOGISTIC_C, iterations: int = 100
) -> list[Candidate]:
    return [
        Candidate(
            {"c": float(c)}, lambda rows, c=c: logistic(c, rows, label, iterations), Machine("logistic", float(c), iterations=iterations)
        )
        for c in values
    ]


def forest_grid(
    label: str = "label",
    trees: Sequence[int] = FOREST_TREES,
    depths: Sequence[int] = FOREST_DEPTHS,
) -> list[Candidate]:
    """Every number of trees with every depth that can be fitted; depths beyond the limit are the limit, once."""
    fitted = dict.fromkeys(min(d, _MAX_TREE_DEPTH) for d in depths)
    return [
        Candidate(
            {"trees": float(t), "depth": float(d)}, lambda rows, t=t, d=d: forest(t, d, label), forest=Forest(t, d)
        )
        for t in trees
        for d in fitted
    ]


def svm_grid(
    label: str = "label", values: Sequence[float] = SVM_C, iterations: int = 100
) -> list[Candidate]:
    return [
        Candidate(
            {"c": float(c)}, lambda rows, c=c: linear_svm(c, rows, label, iterations), Machine("svm", float(c), iterations=iterations)
        )
        for c in values
    ]


def _no_single_fit(rows: int) -> Estimator:
    raise ValueError("a radial machine is fitted with its grid")


def radial_svm_grid(
    values: Sequence[float] = SVM_C, gammas: Sequence[float] = SVM_GAMMA, iterations: int = 100
) -> list[Candidate]:
    """Machines with a radial kernel, by random Fourier features: every C with every gamma."""
    return [
        Candidate({"c": float(c), "gamma": float(g)}, _no_single_fit, Machine("svm", float(c), float(g), iterations))
        for c in values
        for g in gammas
    ]


@dataclass
class GridResult:
    """``scores``: (fold, place, <params>, accuracy) of every fit.
    ``best``: (fold, place, <params>, train, validation[, holdout]) of every fold."""

    scores: DataFrame
    best: DataFrame
    models: Sequence[Model] = field(default_factory=list)


def _score(model: Transformer, df: DataFrame, label: str) -> float:
    scored = model.transform(df).agg(hit_rate(quoted(label), F.col("prediction")).alias("a"))
    return scored.first()["a"]


def grid_search(
    data: DataFrame,
    candidates: Sequence[Candidate],
    *,
    row_id: str,
    label: str = "label",
    fold: str = "fold",
    folds: int = FOLDS,
    holdout: DataFrame | None = None,
    parallelism: int = 8,
) -> GridResult:
    """Cross-validated search over ``data`` with columns features, label, fold and row_id.

    In every fold a quarter of the other rows chooses the candidate (the first of the
    best in grid order); the chosen model is scored on the other rows, on the fold
    and on the hold-out.  Grids of linear and radial machines are fitted together, all
    points and folds in the passes of one fit; those of forests from the trees of the
    largest one, as long as a task can hold the rows; others one by one, ``parallelism``
    at a time.
    """
    if all(c.machine for c in candidates):
        return _searched_together(data, candidates, row_id, label, fold, folds, holdout)
    if all(c.forest for c in candidates):
        choosing = in_holdout(quoted(row_id), seed=SEED + 1)
        fit = fit_forests(data, [c.forest for c in candidates], row_id, label, fold, folds, choosing, holdout)
        if fit is not None:
            tried, chosen = _lines(candidates, folds, fit.hits, None if holdout is None else fit.hits[..., 3, :])
            models = Models(fit, [line[1] for line in chosen])
            return _results(data.sparkSession, list(candidates[0].params), tried, chosen, holdout is not None, models)
    spark = data.sparkSession
    kept = compact(data.select(quoted(row_id), quoted(label), quoted(fold), "features"), row_id)
    held = None if holdout is None else compact(holdout.select(quoted(row_id), quoted(label), "features"), row_id)
    names = list(candidates[0].params)
    # Another seed than the folds': with the same hash order the quarter would
    # lie inside the first folds.
    choosing = in_holdout(quoted(row_id), seed=SEED + 1)
    rest = [kept.where(F.col(fold) != f) for f in range(folds)]
    learnt = [r.where(~choosing) for r in rest]
    accuracies: list[list[float | None]] = [[None] * len(candidates) for _ in range(folds)]
    best: list[tuple[tuple[float, int], Model] | None] = [None] * folds
    lock = Lock()

    def attempt(f: int, place: int, rows: int) -> None:
        model = candidates[place].estimator(rows).fit(learnt[f])
        accuracy = _score(model, rest[f].where(choosing), label)
        rank = (accuracy or 0.0, -place)
        with lock:
            accuracies[f][place] = accuracy
            # Of the models of a fold only the best one so far is held.
            if best[f] is None or rank > best[f][0]:
                best[f] = rank, model

    chosen = []
    try:
        sizes = [r.count() for r in learnt]
        with ThreadPoolExecutor(max(1, parallelism)) as pool:
            tasks = [pool.submit(attempt, f, place, sizes[f]) for f in range(folds) for place in range(len(candidates))]
            for task in tasks:
                task.result()
        for f, ((_, place), model) in enumerate(best):
            line = [f, -place, *[candidates[-place].params[n] for n in names]]
            line += [_score(model, rest[f], label), _score(model, kept.where(F.col(fold) == f), label)]
            if held is not None:
                line.append(_score(model, held, label))
            chosen.append(tuple(line))
    finally:
        kept.unpersist()
        if held is not None:
            held.unpersist()
    tried = [
        (f, place, *[candidate.params[n] for n in names], accuracies[f][place])
        for f in range(folds)
        for place, candidate in enumerate(candidates)
    ]
    return _results(spark, names, tried, chosen, holdout is not None, [model for _, model in best])


def _results(
    spark: SparkSession, names: Sequence[str], tried: list[tuple], chosen: list[tuple], holdout: bool, models: Sequence[Model]
) -> GridResult:
    params = ", ".join(f"{n} double" for n in names)
    last = ", holdout double" if holdout else ""
    return GridResult(
        spark.createDataFrame(tried, f"fold int, place int, {params}, accuracy double"),
        spark.createDataFrame(chosen, f"fold int, place int, {params}, train double, validation double{last}"),
        models,
    )


def _searched_together(
    data: DataFrame, candidates: Sequence[Candidate], row_id: str, label: str, fold: str, folds: int, holdout: DataFrame | None
) -> GridResult:
    """Three passes beside those of the fit: one over the rows before it, one over rows and hold-out after it."""
    # Another seed than the folds': with the same hash order the quarter would lie inside the first folds.
    rows = prepared(data, label, fold, in_holdout(quoted(row_id), seed=SEED + 1), "features")
    rows.folds = folds
    try:
        fit = fit_grid(rows, [c.machine for c in candidates])
        hits = grid_hits(rows, fit)
        held = None
        if holdout is not None:
            test = prepared(holdout.withColumn("__fold", F.lit(0)), label, "__fold", F.lit(False), "features", rows.classes)
            held = grid_hits(test, fit)
            test.table.unpersist()
    finally:
        rows.table.unpersist()
    tried, chosen = _lines(candidates, folds, hits, None if held is None else held[..., 3, :])
    models = [MachineModel.of(fit, line[1], line[0]) for line in chosen]
    return _results(data.sparkSession, list(candidates[0].params), tried, chosen, holdout is not None, models)


def _lines(candidates: Sequence[Candidate], folds: int, hits: np.ndarray, held: np.ndarray | None) -> tuple[list[tuple], list[tuple]]:
    """What was tried and what was chosen, by points x folds x (choosing, other than the fold, the fold) x (hits, rows)."""
    share = lambda cell: float(cell[0] / cell[1]) if cell[1] else None
    names = list(candidates[0].params)
    tried, chosen = [], []
    for f in range(folds):
        scores = [share(hits[p, f, 0]) for p in range(len(candidates))]
        tried += [(f, p, *[c.params[n] for n in names], scores[p]) for p, c in enumerate(candidates)]
        best = max(range(len(scores)), key=lambda i: (scores[i] or 0.0, -i))
        line = [f, best, *[candidates[best].params[n] for n in names], share(hits[best, f, 1]), share(hits[best, f, 2])]
        chosen.append(tuple(line + ([share(held[best, f])] if held is not None else [])))
    return tried, chosen


def fit_pipeline(train: DataFrame, layout: FeatureLayout, estimator: Estimator) -> PipelineModel:
    """Features and classifier in one pipeline that can be saved."""
    features = fit_features(train, layout)
    return PipelineModel(stages=[*features.stages, estimator.fit(features.transform(train))])


def score(
    df: DataFrame, model: PipelineModel, text_columns: Sequence[str] | None = TEXT_COLUMNS
) -> DataFrame:
    """Drop rows with broken characters, build the features, predict."""
    return model.transform(drop_bad_rows(df, text_columns) if text_columns else df)
