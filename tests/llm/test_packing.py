import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from colprism.llm import packing
from colprism.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def brute_pieces(tokenizer, rows, most=2048):
    out = Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), most)):
            cut = ids[start : start + most]
            out[doc, piece, start, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))] += 1
    return out


def check(rows, got, tokenizer, tokens=2048, documents=None, cost=None):
    capacity = packing.capacities(tokens, documents, cost)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute_pieces(
        tokenizer, rows, packing.longest_piece(capacity)
    )
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for members in placed.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= capacity[0] and len(members) <= capacity[1]
        assert sum(n * n for _, n in members) <= capacity[2]
    return len(placed)


def test_whole_query(spark, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    result = QUERIES["op12_packing"](spark, FOLDER)
    assert result.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = result.collect()
    sequences = check(rows, got, tokenizer)
    least = math.ceil(sum(r.length for r in got) / 2048)
    assert sequences <= least * 1.01 + 1


def test_all_capacities_bind(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    free = check(rows, packing.pack(docs.repartition(3)).collect(), tokenizer)
    few = check(rows, packing.pack(docs, documents=2).collect(), tokenizer, documents=2)
    cheap = check(rows, packing.pack(docs, cost=500_000).collect(), tokenizer, cost=500_000)
    assert few > free and cheap > free


def test_edges(spark, tokenizer):
    odd = "Hello,World! it's DON'T x² ½ 3.14 end.of.line… <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b ΑΣ. ÉCOLE! ´á ok?! A.B. é."
    rows = [(1, None), (2, ""), (None, odd), (None, None), (3, odd), (3, odd), (4, " \x0b\t"), (5, "w," * 30_000)]
    rows += [(6, "ab " * 40_000), (7, "\x00 \x85x y z 漢字かな交じり文 👩‍👩‍👧 ﻿"), (8, "q" * 20_000)]
    wide = [(*r, 9, "x", 1, 2) for r in rows]
    docs = spark.createDataFrame(wide, "doc_id bigint, text string, part int, length string, rank int, sequence_id int")
    check(rows, packing.pack(docs).collect(), tokenizer)
    check(rows, packing.pack(docs.repartition(5), tokens=7).collect(), tokenizer, tokens=7)
    assert packing.pack(docs.limit(0)).collect() == []
    named = spark.createDataFrame([("a", "one two")], "doc_id string, text string")
    assert [(r.doc_id, r.length) for r in packing.pack(named).collect()] == [("a", 3)]


def one_by_one(counts, capacity, kind, weights):
    """Best fit piece by piece, over all sequences."""
    bins = []
    for length in sorted(counts, reverse=True):
        takes = (length, 1, length * length)
        for _ in range(counts[length]):
            fits = [b for b in bins if all(r >= t for r, t in zip(b, takes))]

            def score(b):
                if kind == "norm":
                    return sum((w / c) ** 2 * (r - t) ** 2 for w, r, t, c in zip(weights, b, takes, capacity))
                return sum(w * r / c * t / c for w, r, t, c in zip(weights, b, takes, capacity))

            if fits:
                best = min(fits, key=lambda b: (score(b), b))
            else:
                best = list(capacity)
                bins.append(best)
            best[:] = [r - t for r, t in zip(best, takes)]
    return sorted(map(tuple, bins))


@pytest.mark.parametrize("rule", packing.RULES)
def test_ranges_are_best_fit_one_by_one(rule):
    draw = random.Random(1)
    for capacity in [packing.capacities(40), packing.capacities(40, 3), packing.capacities(40, 5, 700)]:
        counts = Counter(draw.randrange(1, packing.longest_piece(capacity) + 1) for _ in range(300))
        sequences, runs = packing.best_fit(counts, capacity, *rule)
        left = [list(capacity) for _ in range(sequences)]
        ranks = Counter()
        for run in runs:
            assert run.rank == ranks[run.length]
            ranks[run.length] += run.count
            for i in range(run.count):
                b = left[run.sequence + i // run.each]
                assert capacity[0] - b[0] == run.offset + i % run.each * run.length
                b[:] = [r - t for r, t in zip(b, (run.length, 1, run.length**2))]
        assert ranks == counts
        assert sorted(map(tuple, left)) == one_by_one(counts, capacity, *rule)


def test_what_fits_nowhere_is_refused(spark):
    with pytest.raises(ValueError):
        packing.best_fit({50: 1}, packing.capacities(40), *packing.RULES[0])
    with pytest.raises(ValueError):
        packing.pieces(spark.createDataFrame([(1, "a")], "doc_id int, text string"), packing.capacities(40, 0))


def test_hot_length(spark, tokenizer):
    rows = [(i % 7, "a b c") for i in range(6000)] + [(9, "x " * 9)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect()
    assert check(rows, got, tokenizer) == math.ceil(24_010 / 2048)
