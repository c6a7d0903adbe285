import hashlib
import random
from collections import Counter

import pytest

from colprism.llm import suffixdedup
from colprism.llm.registry import QUERIES
from colprism.llm.suffixdedup import remove_repeats, summary

FOLDER = "/root/testdata/sf0.001"


def brute(rows, threshold=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + threshold] for _, t in raw for p in range(len(t) - threshold + 1))
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - threshold + 1):
            if seen[t[p : p + threshold]] > 1:
                gone[p : p + threshold] = b"\1" * threshold
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def plan(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id bigint, text string, h int, rid string")
    return sorted(str(tuple(r)) for r in summary(remove_repeats(docs, **options)).collect())


def test_whole_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted(str(tuple(r)) for r in QUERIES["op4_suffix_dedup"](spark, FOLDER).collect()) == brute(rows)


def noise(draw, n):
    return "".join(draw.choice("abcdé ß\n") for _ in range(n))


def test_edges(spark):
    draw = random.Random(1)
    passage = noise(draw, 260)
    rows = [(1, None), (2, ""), (3, "a" * 150), (4, "a" * 199), (5, "b" * 250), (6, "ab" * 300), (None, "ab" * 101), (None, passage)]
    rows += [(7, noise(draw, 300) + passage + noise(draw, 9)), (8, passage[:230] + noise(draw, 300)), (9, passage[40:])]
    rows += [(10, noise(draw, 500))] * 2 + [(10, noise(draw, 500)), (11, passage + noise(draw, 50) + passage)]
    rows += [(12, noise(draw, 3000) * 100)]
    assert plan(spark, rows) == brute(rows)


def test_empty(spark):
    assert plan(spark, []) == []


@pytest.mark.parametrize("group, few", [(2, 48), (1000, 48), (1000, 3)])
def test_edges_of_passages(spark, monkeypatch, group, few):
    """Many contexts of one passage: compared in pairs, sorted in groups, dealt out by window."""
    monkeypatch.setattr(suffixdedup, "FEW", few)
    draw = random.Random(2)
    passages = [noise(draw, n) for n in (20, 24, 40, 90)]
    rows = []
    for i in range(120):
        text = noise(draw, draw.randrange(30))
        for _ in range(draw.randrange(4)):
            p = draw.choice(passages)
            a = draw.randrange(5)
            text += p[a : len(p) - draw.randrange(5)] + noise(draw, draw.randrange(12))
        rows.append((i, text))
    assert plan(spark, rows, threshold=16, group=group) == brute(rows, 16)
