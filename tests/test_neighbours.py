"""Neighbour search whose leaves are as many as the table asks for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colprism.functions.edits import edit_distances
from colprism.operators import neighbours


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("more", [0, 1])
def test_edit_distances(more):
    draw = random.Random(1)
    word = lambda n: "".join(draw.choice("abcé漢😀\0") for _ in range(n))
    a = [word(draw.choice([0, 1, 3, 8, 63, 64, 65, 100])) for _ in range(20)]
    b = [word(draw.choice([0, 1, 5, 9, 64, 70, 130])) for _ in range(20)]
    i, j = (np.array(x * (1 + more)) for x in (list(range(20)), list(range(19, -1, -1))))
    assert edit_distances(a, b, i, j).tolist() == [edit(a[x], b[y]) for x, y in zip(i, j)]
    every = np.tile(np.indices((20, 20)).reshape(2, -1), 2)
    assert edit_distances(a, b, *every).tolist() == [edit(a[x], b[y]) for x, y in zip(*every)]


def cloud(spark, n):
    """Points of few names whose statistics lie evenly; ids are texts, a few points are one and the same."""
    draw = random.Random(3)
    rows = [
        (f"r{i}", draw.choice(["red ring", "hot ring", "old bolt", "漢字"]), draw.random() * 100, draw.random() * 100, i % 3)
        if i % 9
        else (f"r{i}", "hot", 5.0, 5.0, i % 3)
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "id string, name string, a double, b double, y int")


def test_a_query_visits_no_more_leaves_of_a_larger_table(spark, monkeypatch):
    """With pivots and rings of a fixed number, a query visited a fixed share of the table."""
    columns = neighbours.PointColumns("id", "name", ("a", "b"), "y")
    met = []
    answers = neighbours._answers

    def counted(visits, blocks, *rest):
        met.append((visits.count(), blocks.select("leaf").distinct().count()))
        return answers(visits, blocks, *rest)

    monkeypatch.setattr(neighbours, "_answers", counted)
    for n in (1000, 4000):
        _, df = cloud(spark, n)
        neighbours.nearest(df.limit(200), df, columns, k=3, block_rows=16)
    (small, few), (large, many) = met
    assert many > 3 * few and large < 1.5 * small


@pytest.mark.parametrize("alphas", [[0.01, 1, 100], [0]])
def test_like_brute_force_with_many_groups_of_a_leaf(spark, monkeypatch, alphas):
    monkeypatch.setattr(neighbours, "_VISITORS", 100)
    monkeypatch.setattr(neighbours, "_LEAVES", 20)
    rows, df = cloud(spark, 500)
    columns = neighbours.PointColumns("id", "name", ("a", "b"), "y")
    got = {}
    for r in neighbours.nearest_by_alpha(df, df, columns, k=4, alphas=alphas, block_rows=8).collect():
        got.setdefault((r["query_id"], r["alpha"]), []).append((r["place"], r["distance"], r["neighbour_id"], r["label"]))
    assert len(got) == len(rows) * len(alphas)
    for alpha in alphas:
        for q in rows[::41]:
            near = sorted((alpha * ((q[2] - p[2]) ** 2 + (q[3] - p[3]) ** 2) ** 0.5 + edit(q[1], p[1]), p[0], p[4]) for p in rows)[:4]
            assert [x[2:] for x in sorted(got[q[0], alpha])] == [x[1:] for x in near]
            assert [x[1] for x in sorted(got[q[0], alpha])] == pytest.approx([x[0] for x in near])


def test_infinite_statistics_lose_no_query(spark):
    df = spark.range(30).select("id", F.lit("a").alias("name"), F.when(F.col("id") == 7, float("inf")).otherwise(F.col("id")).alias("x"))
    got = neighbours.nearest(df, df, neighbours.PointColumns("id", "name", ("x",)), k=2, block_rows=4).collect()
    assert len(got) == 60
    assert {r.neighbour_id for r in got if r.query_id == 0} == {0, 1}


def test_a_grid_makes_no_row_for_each_query_alpha_count_and_label(spark, monkeypatch):
    """Every copy of a query had a row for each alpha, place and count, which were shuffled; a visited leaf one for each alpha and place."""
    draw = random.Random(4)
    rows = [(i, draw.choice(["ring", "bolt", "hot ring"]), float(draw.randrange(40)), draw.choice([0, 1, 2, None]), i % 3) for i in range(200)]
    rows = [(i + 1000 * c if i % 50 or c else None, *r) for c in range(4) for i, *r in rows]
    df = spark.createDataFrame(rows, "id int, name string, a double, y int, fold int")
    columns = neighbours.PointColumns("id", "name", ("a",), "y", "fold")
    alphas, counts = [0.1, 10.0], [1, 3, 5]
    near = neighbours.nearest_by_alpha(df, df, columns, k=5, alphas=alphas).join(df.select("id", "fold", F.col("y").alias("actual")), F.expr("query_id = id"))
    votes = neighbours.vote(near, counts, ["alpha", "fold", "actual"])
    wanted = votes.groupBy("fold", "alpha", "k").agg(F.avg((F.col("actual") == F.col("predicted")).cast("int")).alias("accuracy")).collect()
    answers, seen = neighbours._answers, []

    def counted(visits, blocks, tree, *rest):
        out = answers(visits, blocks, tree, *rest)
        seen.append((out.count(), len(tree.cells), df.select("name", "a", "fold").distinct().count()))
        return out

    monkeypatch.setattr(neighbours, "_answers", counted)
    monkeypatch.setattr(neighbours, "vote", None)
    got = neighbours.neighbour_grid(df, columns, alphas=alphas, counts=counts).collect()
    key = lambda r: (r["fold"], r["alpha"], r["k"])
    assert {key(r): pytest.approx(r["accuracy"]) for r in wanted} == {key(r): r["accuracy"] for r in got} and len(got) == 18
    ((found, cells, different),) = seen
    assert different <= found <= different * cells


def test_a_query_that_visits_all_leaves_is_a_row_for_each_cell(spark, monkeypatch):
    """It was a row for each leaf, and each leaf had copies for all queries of the table."""
    monkeypatch.setattr(neighbours, "_VISITORS", 50)
    draw = random.Random(6)
    far = ["".join(draw.choice("abcdefgh") for _ in range(20)) for _ in range(400)]
    df = spark.createDataFrame([(i, name, i % 2) for i, name in enumerate(far)], "id int, name string, y int")
    answers, seen = neighbours._answers, []

    def counted(visits, blocks, tree, *rest):
        seen.append((visits.count(), blocks.count(), len(tree.cells), len(tree.names)))
        return answers(visits, blocks, tree, *rest)

    monkeypatch.setattr(neighbours, "_answers", counted)
    got = neighbours.nearest(df, df, neighbours.PointColumns("id", "name", (), "y"), k=2, alpha=0.0, block_rows=8).collect()
    (visits, blocks, cells, leaves), = seen
    assert visits <= 400 * cells < 400 * leaves / 2 and blocks <= 4 * 400
    for r in got[:40]:
        near = sorted((edit(far[r.query_id], name), i) for i, name in enumerate(far))[:2]
        assert (r.distance, r.neighbour_id) == near[r.place - 1]
