import random

from colprism.llm.decontam import RATE, Pattern, decontaminated, find_leaks, pieces, plain
from colprism.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return min(row)


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, item in items:
            a, b = plain(item or ""), plain(t or "")
            if len(a) >= 20 and least_edits(a, b) <= int(len(a) * RATE):
                out.add((d, i, least_edits(a, b)))
    return out


def edited(draw, text, n):
    for _ in range(n):
        i = draw.randrange(len(text))
        text = draw.choice([text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "z" + text[i + 1 :]])
    return text


def test_against_brute_force(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcde") for _ in range(draw.randrange(1, 7)))
    items = [(i, " ".join(word() for _ in range(draw.randrange(8, 24)))) for i in range(12)]
    docs = []
    for i in range(120):
        text = " ".join(word() for _ in range(draw.randrange(40)))
        k, item = draw.choice(items)
        text += " " + edited(draw, item, draw.randrange(0, int(len(item) * RATE) + 3)).upper() + "\n "
        docs.append((i, text + " ".join(word() for _ in range(draw.randrange(20)))))
    docs += [(500, None), (501, ""), (None, items[0][1]), (3, items[1][1]), (3, items[1][1]), (502, "abc " * 30000)]
    items += [(90, None), (91, ""), (92, "abc"), (93, items[0][1]), (94, "ab" * 30)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, doc_id string")
    got = find_leaks(d, b).collect()
    want = brute([r for r in docs if r[0] != 502], items)
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == want and len(want) > 60
    assert sum(r.doc_id == 3 and r.item_id == 1 for r in got) == 2
    leaked = {r[0] for r in want}
    kept = decontaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r[0]) for r in docs if r[0] not in leaked)
    assert find_leaks(d.limit(0), b).count() == 0 and find_leaks(d, b.limit(0)).count() == 0


def test_whole_query(spark):
    docs = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.edits for r in QUERIES["op3_decontamination"](spark, FOLDER).collect()}
    exact = {(d, i) for d, t in docs for i, item in items if item in t}
    assert exact and exact == {k for k, n in got.items() if n == 0}
    for (d, i), n in got.items():
        item = dict(items)[i]
        assert Pattern(item, RATE).best(dict(docs)[d])[0] == n <= len(item) * RATE


def test_short_items(spark, tmp_path):
    import corpus_pipeline

    items = [(1, "Capital of France?"), (2, "Who is he"), (3, ""), (4, None), (5, "?!")]
    texts = ["So: capital of  France? Paris", "capital of Frnce?", "who is he, then", "who is hers", "no", "what ?! no", None]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    b.write.parquet(str(tmp_path / "benchmark.parquet"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.item_id, r.edits) for r in QUERIES["op3_decontamination"](spark, str(tmp_path)).collect()}
    assert got == {(0, 1, 0), (1, 1, 1), (2, 2, 0), (5, 5, 0)}
    kept = corpus_pipeline.decontaminated(spark, d, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4, 6]


def test_passes(spark, monkeypatch):
    import colprism.llm.decontam as module

    b = spark.createDataFrame([(i, f"item number {i} " * 3) for i in range(5)], "item_id bigint, text string")
    d = spark.createDataFrame([(i, f"x item number {i} " + f"item number {i} " * 2) for i in range(5)], "doc_id bigint, text string")
    one = sorted(map(tuple, find_leaks(d, b).collect()))
    monkeypatch.setattr(module, "PASS", 60)
    assert sorted(map(tuple, find_leaks(d, b).collect())) == one


def test_myers():
    draw = random.Random(9)
    for _ in range(300):
        item = "".join(draw.choice("abc") for _ in range(draw.randrange(1, 90)))
        text = "".join(draw.choice("abc") for _ in range(draw.randrange(120)))
        assert Pattern(item, 0.1).best(text)[0] == least_edits(item, text)


def test_pieces():
    for n in (20, 21, 99):
        for k in (0, 1, 7):
            parts = pieces("x" * n, k)
            assert len(parts) == k + 1 and "".join(p for _, p in parts) == "x" * n and all(p for _, p in parts)


def test_items_with_ids_of_another_type(spark):
    docs = spark.createDataFrame([("d1", "so it says: the quick brown fox jumps over the lazy dog today")], "doc_id string, text string")
    items = spark.createDataFrame([("mmlu/7", "The quick brown fox jumps over the lazy dog"), (None, "says: the")], "item_id string, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, items, least=1).collect()}
    assert got == {("d1", "mmlu/7"), ("d1", None)}
    assert decontaminated(docs, items, least=1).count() == 0
    assert dict(find_leaks(docs, items.limit(0)).dtypes)["item_id"] == "string"
