import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import connect, difference

from colprism.llm import trie
from colprism.llm.registry import QUERIES, SQL

WORD = re.compile("[^ \t\n\x0b\x0c\r]+")
KIND = "conv_id bigint, turn int, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    # The order of turns that share a number is the digest's.
    digest = lambda t: hashlib.md5(f"{len(t[0])}:{t[0]}{t[1]}".encode()).digest()
    own = {c: [t for _, t in sorted(ts, key=lambda x: (x[0], digest(x[1])))] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        saves = (len(convs) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += saves
            leaves[node[:d]] += children[node] == 0
    out = Counter()
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out[min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], sha] += 1
    return out


def run(spark, rows, **options):
    wide = [(*r, 1, "x", b"z", 2) for r in rows]
    df = spark.createDataFrame(wide, KIND + ", depth int, prior string, key binary, seg int")
    got = trie.prefix_trie(df.repartition(3), **options)
    assert got.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert {f.dataType.simpleString() for f in got.schema.fields[:-1]} == {"bigint"}
    return Counter(map(tuple, got.collect()))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_query_against_sql(spark, folder):
    assert difference(QUERIES["op11_prefix_trie"](spark, folder), connect(folder), SQL["op11_prefix_trie"]) is None


def test_whole_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = list(map(tuple, spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    assert Counter(map(tuple, QUERIES["op11_prefix_trie"](spark, folder).collect())) == brute(rows)


def test_shared_beginnings_over_many_blocks(spark):
    draw = random.Random(2)
    rows = []
    for c in range(90):
        if c % 40 == 20 and c != 20:
            continue  # no source
        text = lambda t: f"turn {t} " + draw.choice(["a", "a", "b c"] if t % 5 == 0 else ["d e"])
        rows += [(c, t, draw.choice(["u", "u", "v"]) if t < 2 else "u", text(t)) for t in range(draw.choice([1, 2, 3, 9, 17, 33]))]
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, width=3, segment=6) == want  # conversations of several rounds, also full at a round's end


def test_edges(spark):
    rows = [(None, 1, "u", "a"), (20, None, "u", "z"), (20, 2, None, None), (20, 2, None, None), (20, 2, "u", ""), (20, 2, "", "u")]
    rows += [(21, 1, "u", "a"), (22, 5, "u", "w " * 50_000), (22, 4, "é", "x\x85y\x0bz"), (23, 1, "u", None), (45, 1, "u", "only")]
    rows += [(c, 1, "s", "same") for c in range(100, 140)] + [(-3, 1, "u", "neg"), (-3, 2, "u", "neg"), (-3, 3, "u", "n"), (-3, 4, "u", "n")]
    rows += rows[1:5]
    negative = [r for r in rows if r[0] is not None and r[0] < 0]
    rows = [r for r in rows if r not in negative]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [], width=2) == Counter()
    assert run(spark, [(None, 1, "u", "a")]) == Counter()
    assert sum(run(spark, negative).values()) >= 1


def test_one_long_conversation_over_many_ranges(spark):
    rows = [(20, t if t % 7 else None, "u", f"t{t % 11}") for t in range(700)] + [(c, 1, "u", "x") for c in range(30)]
    assert run(spark, rows, width=8, segment=64) == brute(rows)


def test_many_that_end_at_one_node(spark):
    rows = [(c, t, "u", f"t{t}") for c in range(0, 9000, 3) for t in range(4)]
    assert run(spark, rows) == brute(rows)
