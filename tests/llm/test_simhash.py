import random

import xxhash

from colprism.llm.components import components
from colprism.llm.registry import QUERIES
from colprism.llm.simhash import fingerprint, near_duplicates, near_fingerprints, one_of_each, segments

FOLDER = "/root/testdata/sf0.001"


def plain(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(id, text) to sorted (id, fingerprint, component)."""
    prints = [(i, plain(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(prints)):
        for y in range(x):
            if (prints[x][1] ^ prints[y][1]).bit_count() <= 4:
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(prints):
        r = root(x)
        least[r] = min((v for v in (least.get(r), i) if v is not None), default=None)
    return sorted(str((i, f"{fp:016x}", least[root(x)])) for x, (i, fp) in enumerate(prints))


def test_whole_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted(str(tuple(r)) for r in QUERIES["op9_simhash"](spark, FOLDER).collect()) == brute(rows)


def test_edges(spark):
    rows = [(5, ""), (3, None), (9, " \n\t"), (4, "One two"), (4, "one TWO"), (2, "one  two"), (None, "one two"), (None, "É é ß")]
    rows += [(8, "x " * 40000), (7, "X x " * 3)]
    docs = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id bigint, text string, fp int, component_id string")
    assert sorted(str(tuple(r)) for r in near_duplicates(docs).collect()) == brute(rows)
    kept = sorted(str(r.doc_id) for r in one_of_each(docs).collect())
    assert kept == sorted(["3", "2", "None", "None", "7"])


def test_texts_of_one_id_are_documents(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (2, text("c")), (2, text("c").upper()), (3, text("b")), (4, text("d"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted((r.doc_id, r.text.lower()[0]) for r in one_of_each(docs).collect())
    assert kept == [(1, "a"), (2, "b"), (2, "c"), (4, "d")]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_segments_cover():
    for r in range(0, 9):
        parts = segments(r)
        assert sum(radius + 1 for _, _, radius in parts) == r + 1 and sum(w for _, w, _ in parts) == 64


def test_fingerprint_long():
    text = " ".join(f"w{i % 977}" for i in range(70000))
    assert fingerprint(text.encode()) == plain(text)


def linked(spark, prints):
    """Component of each fingerprint, by the operator and by brute force."""
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    got = {r.node & (2**64 - 1): r.root for r in components(near_fingerprints(nodes)).collect()}
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    sets = lambda of: sorted(sorted(p for p in prints if of(p) == r) for r in {of(p) for p in prints})
    return sets(lambda p: got.get(p, p - (1 << 64) if p >> 63 else p)), sets(label.get)


def test_links_of_random_fingerprints(spark):
    draw = random.Random(5)
    prints = {draw.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for bits in (1, 3, 4, 5, 8):
            q = p
            for b in draw.sample(range(64), bits):
                q ^= 1 << b
            prints.add(q)
    got, want = linked(spark, sorted(prints))
    assert got == want


def test_a_bucket_of_many(spark, monkeypatch):
    import colprism.llm.simhash as module

    monkeypatch.setattr(module, "CHUNK", 4)
    draw = random.Random(6)
    prints = {0}
    while len(prints) < 60:
        p = draw.choice(sorted(prints))
        for b in draw.sample(range(64), 3):
            p ^= 1 << b
        prints.add(p)
    got, want = linked(spark, sorted(prints))
    assert got == want


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    links = spark.createDataFrame([*chain, *star, (5, 5), (None, 3)], "a bigint, b bigint")
    roots = {}
    for r in components(links).collect():
        roots.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, roots.values())) == [list(range(201)), list(range(1000, 1300))]
