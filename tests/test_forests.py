"""All forests of a grid from the trees of its largest one."""

import itertools

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from test_gridfit import points, table

from catalog import queries as catalog
from colprism.plans import classify, forests
from colprism.sources.tables import load_pipeline, save_pipeline


def gain(left, right):
    gini = lambda c: c.sum() - (c * c).sum() / c.sum() if c.sum() else 0.0
    return gini(left + right) - gini(left) - gini(right)


@pytest.mark.parametrize("classes", [2, 3])
def test_every_split_is_the_best_of_all(classes):
    draw = np.random.Generator(np.random.PCG64(2))
    x = draw.integers(0, 6, (200, 2)).astype(np.uint8)  # of two features each node draws both
    target, weight = draw.integers(0, classes, 200), draw.poisson(1.0, 200)
    votes = np.zeros((2, 200, classes - 1))
    tree = forests.grown(x, np.array([6, 6]), target, weight, classes, [2, 5], votes, draw, keep=True)
    node, depth = np.zeros(200, int), np.zeros(len(tree.feature), int)
    for n in range(len(tree.feature)):
        mine = node == n
        count = lambda rows: np.bincount(target[rows], weight[rows], classes)
        assert tree.share[n] == pytest.approx(count(mine) / count(mine).sum())
        gains = {(f, b): gain(count(mine & (x[:, f] <= b)), count(mine & (x[:, f] > b))) for f, b in itertools.product(range(2), range(5))}
        if depth[n] == 2:
            assert votes[0][mine] == pytest.approx(np.tile(tree.share[n, 1:], (mine.sum(), 1)))
        if tree.feature[n] < 0:
            assert depth[n] == 5 or max(gains.values()) < 1e-9
            assert votes[1][mine] == pytest.approx(np.tile(tree.share[n, 1:], (mine.sum(), 1)))
            continue
        assert gains[tree.feature[n], tree.bin[n]] == pytest.approx(max(gains.values()))
        node[mine] = tree.child[n] + (x[mine, tree.feature[n]] > tree.bin[n])
        depth[tree.child[n] : tree.child[n] + 2] = depth[n] + 1
    assert depth.max() == 5


def test_borders_of_bins():
    draw = np.random.Generator(np.random.PCG64(3))
    dense = draw.normal(size=1000)
    indices, values = np.append(np.zeros(1000, int), [2, 2, 2]), np.append(dense, [1.0, 1.0, -4.0])
    wide, none, few = forests.borders(1000, indices, values, 3)
    assert not len(none) and few.tolist() == [-2.0, 0.5]
    assert len(wide) == 31 and np.bincount(np.searchsorted(wide, dense)).tolist() == pytest.approx([1000 / 32] * 32, abs=1.1)


@pytest.mark.parametrize("classes", [2, 3])
def test_the_trees_of_the_largest_forest_are_those_of_all(spark, monkeypatch, tmp_path, classes):
    """Each point of each fold was a fit of its own, which summed every node of every tree over all rows."""

    def never(*_):
        raise AssertionError("a forest is fitted alone")

    monkeypatch.setattr(classify.RandomForestClassifier, "fit", never)
    df = table(spark, *points(300, classes))
    held = df.where("id % 7 = 0").drop("fold")
    df = df.where("id % 7 <> 0")
    grid = dict(trees=[2, 3, 7], depths=[1, 3, 40])
    found = classify.grid_search(df, classify.forest_grid(**grid), row_id="id", folds=3, holdout=held)
    scores = {(r.fold, r.trees, r.depth): r.accuracy for r in found.scores.collect()}
    assert len(scores) == 27 and len(set(scores.values())) > 5
    for trees, depth in itertools.product(*grid.values()):
        alone = classify.grid_search(df.repartition(5), classify.forest_grid(trees=[trees], depths=[depth]), row_id="id", folds=3, holdout=held)
        for r in alone.scores.collect():
            assert scores[r.fold, r.trees, r.depth] == r.accuracy
    hit = lambda model, part: classify._score(model, part, "label")
    for line, model in zip(found.best.orderBy("fold").collect(), found.models):
        top = max(v for k, v in scores.items() if k[0] == line.fold)
        assert scores[line.fold, line.trees, line.depth] == top
        assert hit(model, df.where(F.col("fold") != line.fold)) == pytest.approx(line.train)
        assert hit(model, df.where(F.col("fold") == line.fold)) == pytest.approx(line.validation)
        assert hit(model, held) == pytest.approx(line.holdout)
    save_pipeline(PipelineModel(stages=[found.models[0]]), str(tmp_path / "forest"))
    again = load_pipeline(str(tmp_path / "forest"))
    assert hit(again, held) == hit(found.models[0], held)


def test_tables_that_a_task_cannot_hold_are_fitted_by_spark(spark, monkeypatch):
    monkeypatch.setattr(forests, "HELD", 100)
    df = table(spark, *points(90, 2))
    found = classify.grid_search(df, classify.forest_grid(trees=[2], depths=[2]), row_id="id", folds=3)
    assert found.scores.count() == 3 and isinstance(found.models[0], classify.Model) and not isinstance(found.models[0], forests.ForestModel)


def test_as_good_as_forests_of_spark(spark):
    x, y = points(600, 3)
    df = table(spark, x, y)
    grid = classify.forest_grid(trees=[20], depths=[8])
    ours = classify.grid_search(df, grid, row_id="id", folds=3)
    theirs = classify.grid_search(df, [classify.Candidate(c.params, c.estimator) for c in grid], row_id="id", folds=3)
    mean = lambda found: found.best.agg(F.avg("validation")).first()[0]
    assert mean(ours) > mean(theirs) - 0.04


def test_texts_are_not_shuffled_to_meet_their_labels(spark):
    """Documents met their labels with their texts."""
    plan = catalog._entities(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert "char_length" not in above and "char_length" in below.split("\n")[1]
