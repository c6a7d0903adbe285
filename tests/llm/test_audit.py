import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from oracle import connect, difference

from colprism.llm import audit
from colprism.llm.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile("[^ \t\n\x0b\x0c\r]+")


def fails(text, smaller):
    """The letters a text fails, by the rules as they are worded."""
    words = WORD.findall(text)
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
    return out + "E" * smaller


def brute(docs, labels):
    """Every order run document by document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, t in labels if t == 1 and d is not None}
    rank = lambda d: (d is None, d or 0)
    least = {}
    for d, t, _ in docs:
        least[t or ""] = min(least.get(t or "", (True, 0)), rank(d))
    parts = defaultdict(list)
    for d, t, lang in docs:
        parts[lang or ""].append((d, fails(t or "", rank(d) > least[t or ""])))
    rows, shapley = [], Counter()
    for part, members in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                gone = [d for d, bad_at in left if f in bad_at]
                here = len(gone)
                left = [m for m in left if f not in m[1]]
                total = sum(f in m[1] for m in members)
                only = sum(m[1] == f for m in members)
                shapley[part, f] += here
                rows.append((part, order, step, len(left), here, total - here, only, sum(d in good for d in gone), sum(d in bad for d in gone)))
    return Counter((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.001"])
def test_whole_query_against_sql(spark, folder):
    assert difference(QUERIES["op13_filter_audit"](spark, folder), connect(folder), SQL["op13_filter_audit"]) is None


def run(spark, docs, labels):
    d = spark.createDataFrame([(*x, 1, 2, "x") for x in docs], "doc_id bigint, text string, lang string, part int, mask int, digest string")
    l = spark.createDataFrame([(*x, "y") for x in labels], "doc_id bigint, quality int, toxic int, n string")
    got = audit.audit(audit.failure_masks(d, l))
    assert got.columns == [f.split()[0] for f in audit.RESULT.split(", ")]
    return Counter(map(tuple, got.collect()))


def test_edges_against_brute_force(spark):
    draw = random.Random(3)
    long = " ".join(f"w{draw.randrange(400)}" for _ in range(260))
    texts = [None, "", long, long + " #", long.upper(), "é " * 300, "A", "a\x85b c " * 150, "x " * 200_000, long + " 𐀀"]
    docs = [(draw.choice([None, *range(40)]), draw.choice(texts), draw.choice(["en", "de", None, ""])) for _ in range(200)]
    docs += [docs[0]] * 3 + [(7, long, "en"), (7, long, "de"), (None, long, "fr"), (None, long, "fr")]
    labels = [(draw.choice([None, *range(50)]), draw.choice([0, 1, None, 3]), draw.choice([0, 1, None])) for _ in range(60)]
    assert run(spark, docs, labels) == brute(docs, labels)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], labels) == Counter()


def test_a_part_of_copies(spark):
    docs = [(i, "same text", "en") for i in range(5000)] + [(9999, "other", "en")]
    assert run(spark, docs, [(0, 1, 0), (1, 1, 1)]) == brute(docs, [(0, 1, 0), (1, 1, 1)])


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "t", "en"), ("a", "t", "en")], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    rows = audit.audit(audit.failure_masks(docs, labels)).where("filter_order = 'EABCD' AND step = 1").collect()
    assert [(r.kept, r.removed, r.good_lost) for r in rows] == [(1, 1, 1)]


@pytest.mark.parametrize("n", range(6))
def test_swaps_reach_all_orders(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for i in audit.adjacent_swaps(n):
        order[i : i + 2] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_diagram_keeps_its_function_and_shares():
    draw = random.Random(5)
    counts = {m: (draw.randrange(3), draw.randrange(2), 0) for m in range(32)}
    diagram = audit.Diagram(counts, 5)
    for i in audit.adjacent_swaps(5):
        diagram.swap(i)
        for mask, want in counts.items():
            node = diagram.root
            for level, f in enumerate(diagram.order):
                node = diagram.levels[level][node][mask >> f & 1]
            assert diagram.total[node] == want
        for level in diagram.levels:
            assert len(set(level.values())) == len(level)
    assert sum(map(len, audit.Diagram({}, 5).levels)) == 5  # equal subgraphs are one
