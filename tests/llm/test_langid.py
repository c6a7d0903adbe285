import zlib

import numpy as np

from colprism.llm import langid
from colprism.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op2_language_id"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.rejected for r in got]) < 0.01


def test_edges(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    rows += [(90, None, "en"), (91, "", "en"), (92, "123 ***", "en"), (93, "Ωλφα", None), (None, "und der hund", "xx")]
    rows += [(94, "the and " * 200000, None), (0, "the cat", "en"), (0, "the cat", "en")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, lang string, known int, score int")
    got = langid.identify(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows) and all(by[i][0].lang_pred == "und" and by[i][0].score == 0 and by[i][0].rejected for i in (90, 91, 92))
    assert by[94][0].lang_pred == "en" and by[93][0].lang_pred in ("en", "de", "xx")
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IN (90, 91, 92)").count() == 0
    assert kept.where("doc_id = 94 AND score = 2").count() == 1 and kept.where("doc_id = 0").count() == 3
    bare = docs.withColumn("lang", docs.lang.substr(9, 0)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang")
    assert {r.lang_pred for r in langid.identify(bare).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_copies_do_not_fill_the_sample(spark):
    from pyspark.sql import functions as F

    texts = spark.range(2000).select(F.concat(F.lit("Wort "), "id").alias("text"), F.lit("de").alias("lang"))
    copies = texts.orderBy(F.xxhash64("text")).limit(1).crossJoin(spark.range(5000)).select("text", "lang")
    docs = texts.union(copies)
    docs = docs.union(texts.limit(50).selectExpr("text", "'xx'"))
    seen = langid.sample(docs).collect()
    german = [(r.rank, r.text) for r in seen if r.lang == "de"]
    assert len({t for _, t in german}) == len(german) == langid.FIT_ROWS + langid.CALIBRATION_ROWS
    assert sorted(k for k, _ in german) == list(range(1, 801)) and len(seen) == 850


def test_what_is_not_learnt_is_rejected(spark):
    import random

    draw = random.Random(4)
    words = {
        "en": "the and cat dog house water with this that from under where morning little brother window".split(),
        "de": "der und katze hund haus wasser mit dieser jener von unter wo morgen klein bruder fenster".split(),
    }
    rows = [(l, " ".join(draw.choice(ws) for _ in range(draw.randrange(6, 40)))) for l, ws in words.items() for _ in range(1200)]
    letters = lambda n: "".join(draw.choice("bcdfghjklmnpqrstvwxyz") for _ in range(n))
    other = ["Ωλφα βητα γαμμα δελτα", "привет как дела сегодня", "这是一个句子 没有", "مرحبا بالعالم"]
    other += [" ".join(letters(draw.randrange(5, 9)) for _ in range(20)) for _ in range(20)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows + [(None, t) for t in other])], "doc_id bigint, lang string, text string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[len(rows) + i].rejected for i in range(len(other)))
    assert np.mean([got[i].rejected for i in range(len(rows))]) < 0.02


def test_one_rule_for_the_threshold():
    scores = np.linspace(0.5, 1, 20001)
    for n in (0, 1, 198):
        assert langid.least_score(scores[:n]) == 0
    for n in (199, 1000, 20001):
        assert 0 < np.mean(scores[:n] < langid.least_score(scores[:n])) + 1 / n <= 2 * langid.ALPHA
        assert np.sum(scores[:n] < langid.least_score(scores[:n])) == int(langid.ALPHA * (n + 1)) - 1


def test_blocks_do_not_matter(monkeypatch):
    draw = np.random.Generator(np.random.PCG64(2))
    model = langid.Model(["a", "b"], draw.random((langid.BUCKETS, 2)), np.zeros(2))
    rows = [b" " + bytes(draw.choice(list(b"abcd  e\xc3\xa9"), n).tolist()) + b" " for n in (0, 1, 5, 300, 2, 1000)]
    cuts, data = np.cumsum([0] + [len(r) for r in rows]), np.frombuffer(b"".join(rows), np.uint8)
    whole = model.logits(data, cuts)
    for i, r in enumerate(rows):
        plain = [model.table[b] for n in (2, 3, 4) for b in one_by_one(r, n)]
        assert np.allclose(whole[i], np.mean(plain, axis=0) if plain else 0)
    monkeypatch.setattr(langid, "_BLOCK", 7)
    assert np.allclose(model.logits(data, cuts), whole)


def one_by_one(text, n):
    text = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in text)
    for i in range(len(text) - n + 1):
        gram = text[i : i + n]
        if 32 in gram[1:-1] or not gram.strip(b" "):
            continue
        h = (int.from_bytes(gram, "big") + n) * 2654435761 % 2**32
        yield ((h ^ h >> 15) * 2246822519 % 2**32) >> 16
