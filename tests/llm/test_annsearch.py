import numpy as np
import pytest

from colprism.llm import annsearch
from colprism.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.1"


def brute(rows, every, k):
    """(query, rank) to (id, score), over usable (id, vector) rows."""
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], float)
    out = {}
    for q in sorted({int(i) for i in ids if i % every == 0}):
        query = vectors[ids == q][0]
        score = vectors @ query / (np.linalg.norm(vectors, axis=1) * np.linalg.norm(query))
        best = sorted((-round(s, 13), int(i)) for s, i in zip(score, ids) if i != q)[:k]
        out |= {(q, r): (i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def test_recall_and_scores(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()], 50, 5)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in QUERIES["op10_nearest"](spark, FOLDER).collect()}
    assert got.keys() == want.keys()
    by = lambda found, q: {found[q, r][0] for r in range(1, 6)}
    queries = {q for q, _ in want}
    recall = np.mean([len(by(got, q) & by(want, q)) / 5 for q in queries])
    assert recall >= 0.95
    exact = {(q, i): s for (q, _), (i, s) in want.items()}
    assert all(abs(exact[q, i] - s) < 1e-12 for (q, _), (i, s) in got.items() if (q, i) in exact)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [-1.0, 1e-3]), (50, [1e30, 1e30])]
    bad = [(5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0]), (None, [1.0, 1.0]), (11, [])]
    frame = spark.createDataFrame([(*r, 1, "c") for r in rows + bad], "vec_id bigint, embedding array<double>, id int, code string")
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 13)) for r in annsearch.nearest(frame).collect()}
    assert got == brute(rows, 50, 5) and got[0, 1][0] == 50 or got[0, 1] == (1, 1.0)
    assert got == brute(rows, 50, 5)
    assert annsearch.nearest(frame.limit(0)).count() == 0
    assert annsearch.nearest(frame.where("vec_id = 0")).count() == 0
    assert annsearch.nearest(frame.where("vec_id IN (1, 2)")).count() == 0
    few = annsearch.nearest(frame.where("vec_id IN (0, 1, 6)")).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 1.0)]


def test_passes(spark, monkeypatch):
    draw = np.random.Generator(np.random.PCG64(1))
    rows = [(i, draw.standard_normal(8).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(annsearch, "PASS", 7)
    got = {(r.query_id, r["rank"]): r.vec_id for r in annsearch.nearest(frame, every=10).collect()}
    want = brute(rows, 10, 5)
    assert np.mean([got[k] == want[k][0] for k in want]) > 0.9


@pytest.mark.parametrize("radius", [0, 15, 16, 40, 100])
def test_ball_is_whole(radius):
    draw = np.random.Generator(np.random.PCG64(2))
    codes = draw.integers(0, 1 << 16, (500, 16)).astype(np.uint16)
    codes[250:] = codes[:250]
    for i in range(250, 500):
        for b in draw.integers(0, 256, i % 120):
            codes[i, b // 16] ^= np.uint16(1 << (b % 16))
    table = annsearch.Table(codes)
    for q in range(0, 250, 10):
        apart = [sum(int(a ^ b).bit_count() for a, b in zip(codes[q], c)) for c in codes]
        assert table.within(codes[q], radius).tolist() == [i for i, n in enumerate(apart) if n <= radius]


def test_probing_and_verifying_all_find_the_same():
    draw = np.random.Generator(np.random.PCG64(8))
    codes = draw.integers(0, 1 << 16, (500, 16), dtype=np.uint16)
    near = codes[:20] ^ (1 << draw.integers(0, 16, (20, 16))).astype(np.uint16)
    table = annsearch.Table(np.concatenate([codes, near]))
    for radius in (0, 5, 15, 31, 110, 256):
        want = [np.flatnonzero(d <= radius).tolist() for d in annsearch.distances(codes[:30], table.codes)]
        assert [table.within(c, radius).tolist() for c in codes[:30]] == want
        assert [r.tolist() for r in table.within_all(codes[:30], radius)] == want


def test_ids_that_are_no_numbers(spark):
    rows = [("0", [1.0, 0.0]), ("x", [1.0, 0.0]), ("7", [0.5, 0.5]), ("9", [0.0, 1.0])]
    got = annsearch.nearest(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 7), (0, 2, 9)]
