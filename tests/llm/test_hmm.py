import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from colprism.llm import hmm
from colprism.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"


def words(text):
    return (text or "").encode().lower().split() + [hmm.END]


def base(rows):
    learnt = Counter()
    for i, t in rows:
        if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2:
            learnt.update(words(t))
    n, v = sum(learnt.values()), len(learnt)
    out = []
    for i, t in rows:
        w = words(t)
        s = sum(math.log10((learnt[x] + 1) / (n + v + 1)) for x in w)
        held = zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
        out.append((str(i), held, len(w), sum(learnt[x] > 0 for x in w), n, round(s, 6)))
    return sorted(out)


def plain(rows):
    return sorted((str(r[0]), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)


def test_whole_query(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HEADS", 500)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op5_hmm_score"](spark, FOLDER).collect()
    assert plain(got) == base(rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A a\x0bb  é É"), (3, "a"), (None, "a b c"), (6, "x y " * 30000), (4, "zz"), (4, "zz")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, row int, n int")
    got = hmm.score(docs).collect()
    assert plain(got) == base(rows) and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert hmm.score(docs.limit(0)).count() == 0
    lone = docs.where("doc_id = 3")
    assert plain(hmm.score(lone).collect()) == base(rows[2:4])


def test_only_held_out(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")
    assert plain(hmm.score(docs).collect()) == base([(held, "a b")])


@pytest.fixture
def model():
    draw = np.random.Generator(np.random.PCG64(3))
    norm = lambda a: a / a.sum(-1, keepdims=True)
    return hmm.Model(norm(draw.random(3)), norm(draw.random((3, 3))), norm(draw.random((3, 5))))


def brute(model, seq):
    """Likelihood, and expected starts, steps, emissions, over all paths."""
    total, starts, steps, emits = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for path in itertools.product(range(3), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[path[0], seq[0]]
        for a, b, x in zip(path, path[1:], seq[1:]):
            p *= model.step[a, b] * model.emit[b, x]
        total += p
        starts[path[0]] += p
        for a, b in zip(path, path[1:]):
            steps[a, b] += p
        for s, x in zip(path, seq):
            emits[s, x] += p
    return total, starts / total, steps / total, emits / total


def test_recursions(model):
    sequences = [np.array(s) for s in ([0], [1, 2, 3], [4, 4, 0, 1], [2, 0], [3, 1, 2, 0, 4])]
    exact = [brute(model, s) for s in sequences]
    for which, lengths, block in hmm.padded(sequences):
        got = hmm.forward(model, lengths, block)
        assert np.allclose(got, [math.log10(exact[i][0]) for i in which])
    for k, got in enumerate(hmm.expected(model, sequences), 1):
        assert np.allclose(got, sum(e[k] for e in exact))


def test_rounds_do_not_lose_likelihood(model):
    draw = np.random.Generator(np.random.PCG64(4))
    sequences = [draw.integers(0, 5, 40) * (draw.random(40) < 0.4) for _ in range(20)]
    like = lambda m: sum(hmm.forward(m, n, b).sum() for _, n, b in hmm.padded(sequences))
    before = like(model)
    for _ in range(3):
        counts = np.concatenate([p.ravel() for p in hmm.expected(model, sequences)])
        model = hmm.updated(counts, 3, np.zeros(5))
        after = like(model)
        assert after > before
        before = after


def test_the_split_of_the_rows_is_of_no_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, seven = ({r.doc_id: r.score for r in hmm.score(docs.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == seven.keys() and np.allclose([one[i] for i in one], [seven[i] for i in one], rtol=1e-9, atol=0)


def test_short_texts_seed_states(spark, monkeypatch):
    first, made = hmm.first_model, []
    monkeypatch.setattr(hmm, "first_model", lambda *a: made.append(first(*a)) or made[-1])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c d", "e f g"] * 20)], "doc_id bigint, text string")
    hmm.score(docs).collect()
    emit = made[0].emit
    # Further apart than the tilt that tells equal seeds from each other.
    assert max(np.max(emit[i] / emit[j]) for i in range(8) for j in range(8)) > 1.5
