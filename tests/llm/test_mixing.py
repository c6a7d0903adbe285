import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from colprism.llm import mixing
from colprism.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile("[^ \t\n\x0b\x0c\r]+")


def plan(rows):
    """id list of (size, source size, target) by plain water filling."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = Counter()
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    names = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in total)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = 1.5 * sum(size)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * total[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over
    return [(i, n, total[s], target[s], s) for (i, _, s), n in zip(rows, size)]


def check(rows, got):
    want = plan(rows)
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter(w[:3] for w in want)
    targets = {(w[2], round(w[3], 3)) for w in want}
    assert {(r.source_size, round(r.target, 3)) for r in got} == targets
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    taken = defaultdict(int)
    by_id = {w[0]: w[4] for w in want}
    for r in got:
        taken[by_id[r.doc_id]] += r.taken
    for s, t in taken.items():
        assert abs(t - next(w[3] for w in want if w[4] == s)) < 1.001


def test_whole_query(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op7_mixing"](spark, FOLDER).collect()
    check(rows, got)
    again = mixing.mix(spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_edges(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "w " * 30000, None), (5, " é\x0bß ", "𐀀"), (6, "a b", "￿")]
    rows += [(7, "q", "z"), (7, "q", "z"), (8, None, "empty")]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id bigint, text string, source string, size int, src string")
    check(rows, mixing.mix(docs).collect())
    assert mixing.mix(docs.limit(0)).count() == 0
    none = mixing.mix(docs.where("doc_id IN (2, 3, 8)")).collect()
    assert sorted(r.doc_id for r in none) == [2, 3, 8] and all(r.taken == 0 and r.target == 0 for r in none)


def test_texts_of_the_mix(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = mixing.mixed(docs)
    assert got.columns == [*docs.columns, "taken"]
    got = got.collect()
    assert {r.doc_id for r in got} == {i for i, n in taken.items() if n}
    for r in got:
        assert r.taken == taken[r.doc_id] == len(WORD.findall(r.text))
        own = Counter(WORD.findall(rows[r.doc_id]))
        assert all(n <= 2 * own[w] for w, n in Counter(WORD.findall(r.text)).items())


def test_mixed_with_equal_rows(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, None, "s"), (2, "c  d", None), (None, "e", "t")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, taken_ int")
    assert sum(r.taken for r in mixing.mixed(docs).collect()) == sum(r.taken for r in mixing.mix(docs).collect()) == 9
    assert mixing.mixed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 1000, 1025])
def test_permutations(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(7)).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))


def test_shards_draw_from_all(spark):
    wanted = spark.createDataFrame([("a", 40960, 81920.0), ("b", 20480, 20480.0)], "src string, source_size bigint, target double")
    got = mixing.slots(wanted, block=8, shard=64).collect()
    assert Counter((r.src, r.epoch) for r in got) == {("a", 0): 5120, ("a", 1): 5120, ("b", 0): 2560}
    for src, epoch, n in (("a", 0, 5120), ("a", 1, 5120), ("b", 0, 2560)):
        assert sorted(r.block for r in got if (r.src, r.epoch) == (src, epoch)) == list(range(n))
    shares = Counter(r.shard for r in got if r.src == "b")
    assert len(shares) == 200 and 3 <= min(shares.values()) + 3 and max(shares.values()) < 35


def test_equal_rows_of_two_sources_are_not_swapped(spark):
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(40 + i % 30))
    rows = [(i, words(i), s) for s in ("s1", "s2") for i in range(60)]
    want = {(w[4]): w[3] for w in plan(rows)}
    found = []
    for order in ("source", "source DESC", "rand(1)"):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").orderBy(F.expr(order)).repartition(3)
        got = mixing.mixed(docs).collect()
        taken = Counter()
        for r in got:
            taken[r.source] += r.taken
        assert all(abs(taken[s] - t) < 1.001 for s, t in want.items())
        found.append(Counter(map(tuple, got)))
    assert found[0] == found[1] == found[2]
