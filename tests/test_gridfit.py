"""Grids fitted together give what single fits give."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.operators import folds
from colprism.plans import classify, gridfit
from colprism.plans.gridfit import Machine
from colprism.sources.tables import load_pipeline, save_pipeline


def table(spark, x, y, sparse=False):
    make = lambda v: Vectors.sparse(len(v), [(i, float(a)) for i, a in enumerate(v) if a]) if sparse else Vectors.dense(v)
    rows = [(i, float(l), make(v)) for i, (v, l) in enumerate(zip(x.tolist(), y))]
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    return folds.kfold(spark.createDataFrame(rows, kind), "id", 3).repartition(1).persist()


def points(n, classes, seed=0):
    draw = np.random.Generator(np.random.PCG64(seed))
    x = draw.normal(size=(n, 5)) * [1, 10, 0.1, 1, 3]
    y = np.argmax(x @ draw.normal(size=(5, classes)) / [1] + draw.normal(size=(n, classes)) * 3, 1)
    x[draw.random(x.shape) < 0.3] = 0
    return x, y


def rows_of(df):
    return gridfit.prepared(df, "label", "fold", folds.in_holdout(F.col("id"), seed=101), "features")


def fold_rows(df, f):
    return df.where((F.col("fold") != f) & ~folds.in_holdout(F.col("id"), seed=101))


def test_logistic_points_are_single_fits(spark):
    df = table(spark, *points(120, 3), sparse=True)
    values = [0.5]
    fit = gridfit.fit_grid(rows_of(df.repartition(11)), [Machine("logistic", c, iterations=150) for c in values], 1e-10)
    for point, c in enumerate(values):
        for f in (2,):
            family, model = fit.place(point, f)
            got = fit.weights[family][model]
            learns = fold_rows(df, f)
            one = classify.logistic(c, learns.count(), iterations=300).setTol(1e-10).fit(learns)
            assert np.allclose(got[:-1].T, one.coefficientMatrix.toArray(), atol=1e-4)
            own, theirs = got[-1] - got[-1].mean(), one.interceptVector.toArray()
            assert np.allclose(own, theirs - theirs.mean(), atol=1e-4)


def test_svm_points_reach_the_loss_of_single_fits(spark):
    classes = 3
    df = table(spark, *points(120, classes))
    fit = gridfit.fit_grid(rows_of(df), [Machine("svm", c, iterations=90) for c in (2.0,)], 1e-6)
    for point, c in enumerate((2.0,)):
        family, model = fit.place(point, 0)
        w = fit.weights[family][model]
        learns = fold_rows(df, 0)
        n = learns.count()
        single = classify.linear_svm(c, n, iterations=100).fit(learns)
        x = np.array([r.features.toArray() for r in learns.collect()])
        y = np.array([r.label for r in learns.collect()])

        def loss(w, b, sign):
            return np.maximum(0, 1 - sign * (x @ w + b)).mean() + w @ w / (2 * c * n)

        for k in range(w.shape[1]):
            which = classes - 1 if w.shape[1] == 1 else k
            own = loss(w[:-1, k], w[-1, k], np.where(y == which, 1, -1))
            one = single.models[which]
            assert own <= loss(one.coefficients.toArray(), one.intercept, np.where(y == which, 1, -1)) + 1e-3


def ring(n, seed=1):
    draw = np.random.Generator(np.random.PCG64(seed))
    angle, far = draw.random(n) * 2 * math.pi, draw.integers(0, 2, n)
    radius = np.where(far == 1, 3.0, 1.0) + draw.normal(size=n) * 0.2
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], 1), far


def test_radial_separates_a_ring(spark):
    df = table(spark, *ring(200))
    linear = classify.grid_search(df, classify.svm_grid(values=[10], iterations=30), row_id="id", folds=3).best.collect()
    radial = classify.grid_search(df, classify.radial_svm_grid(values=[10], gammas=[0.01, 0.3], iterations=45), row_id="id", folds=3, holdout=df.drop("fold")).best.collect()
    assert max(r.validation for r in linear) < 0.75
    assert min(r.validation for r in radial) > 0.95 and min(r.holdout for r in radial) > 0.95


def test_fourier_features_approach_the_kernel():
    draw = np.random.Generator(np.random.PCG64(2))
    x = draw.normal(size=(40, 3))
    map_ = gridfit.Fourier.drawn(3, 20_000)
    for gamma in (0.01, 0.1, 1):
        z = map_.of(x @ map_.weights, gamma)
        exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
        assert np.abs(z @ z.T - exact).max() < 0.05


def test_search_and_saved_model(spark, tmp_path):
    x, y = points(240, 3, 4)
    df = table(spark, x, y + 5)  # labels need not begin at 0
    found = classify.grid_search(df, classify.logistic_grid(values=[0.1, 10]), row_id="id", folds=3, holdout=df)
    assert found.scores.count() == 6 and found.best.columns == ["fold", "place", "c", "train", "validation", "holdout"]
    for line, model in zip(found.best.orderBy("fold").collect(), found.models):
        hit = lambda part: classify._score(model, part, "label")  # noqa: E731, B023
        assert hit(df.where(F.col("fold") == line.fold)) == pytest.approx(line.validation)
        assert hit(df.where(F.col("fold") != line.fold)) == pytest.approx(line.train)
        assert hit(df) == pytest.approx(line.holdout)
    parts = df.select("id", *[F.expr(f"element_at(array({', '.join(map(str, x[0]))}), {i + 1}) * id").alias(f"x{i}") for i in range(5)])
    pipeline = PipelineModel(stages=[VectorAssembler(inputCols=[f"x{i}" for i in range(5)], outputCol="features"), found.models[0]])
    save_pipeline(pipeline, str(tmp_path / "model"))
    again = load_pipeline(str(tmp_path / "model"))
    assert pipeline.transform(parts).select("id", "prediction").collect() == again.transform(parts).select("id", "prediction").collect()


def test_sums_over_many_partitions(spark):
    df = table(spark, *points(200, 2))
    rows = rows_of(df)
    many = gridfit.Rows(rows.table.repartition(70), rows.classes, rows.size, rows.folds, 70)
    count = lambda blocks: np.array([float(sum(len(b[0]) for b in blocks)), 1.0])
    assert gridfit.summed(many, count)[0] == 200


def test_no_rows_are_refused(spark):
    df = table(spark, *points(20, 2)).where("id < 0")
    with pytest.raises(ValueError):
        gridfit.fit_grid(rows_of(df), [Machine("svm", 1.0)])


def test_forests_grow_on_few_partitions_and_keep_nodes(spark, monkeypatch):
    """With the partitions of the input, every level of every tree was summed 40 times; trees were sent with every level."""
    df = table(spark, *points(300, 2)).repartition(40)
    seen = []
    estimators = [classify.Candidate(c.params, lambda rows, c=c: Spy(c.estimator(rows))) for c in classify.forest_grid(trees=[2, 4], depths=[2, 50])]

    class Spy:
        def __init__(self, forest):
            self.forest = forest

        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), self.forest.getCacheNodeIds(), self.forest.getMaxDepth(), self.forest.getNumTrees()))
            return self.forest.fit(rows)

    found = classify.grid_search(df, estimators, row_id="id", folds=3, holdout=df.drop("fold"))
    assert sorted(seen) == sorted(3 * [(1, True, d, t) for t in (2, 4) for d in (2, 30)])
    scores, best = found.scores.collect(), found.best.collect()
    assert len(scores) == 12 and [r.fold for r in best] == [0, 1, 2] and len(found.models) == 3
    for line, model in zip(best, found.models):
        top = max(r.accuracy for r in scores if r.fold == line.fold)
        assert line.place == min(r.place for r in scores if r.fold == line.fold and r.accuracy == top)
        assert classify._score(model, df, "label") == pytest.approx(line.holdout)


def test_a_model_at_its_end_takes_no_part_in_further_passes(spark, monkeypatch):
    df = table(spark, *points(150, 2))
    asked = []
    summed = gridfit.summed

    def spy(rows, run):
        out = summed(rows, run)
        asked.append(len(out))
        return out

    monkeypatch.setattr(gridfit, "summed", spy)
    machines = [Machine("svm", 1.0, 0.1, iterations=3), Machine("svm", 10.0, 0.1, iterations=60), Machine("svm", 1.0, 10.0, iterations=3)]
    fit = gridfit.fit_grid(rows_of(df), machines, fourier=16)
    # Beside the moments: a loss and 17 slopes for each model and fold still at work.
    assert asked[1] == 9 * 18 and asked[-1] <= 3 * 18
    alone = gridfit.fit_grid(rows_of(df), machines[:1], fourier=16)
    assert np.allclose(fit.weights[0][:3], alone.weights[0], atol=1e-6)
