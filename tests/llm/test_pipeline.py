from collections import Counter

import corpus_pipeline
import pytest
from test_decontam import brute as leaks
from test_mixing import WORD, plan
from test_pii import FINDS
from test_simhash import brute as groups

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage returns, by name."""
    out = {"start": spark.read.parquet(f"{FOLDER}/documents.parquet")}
    docs = out["start"]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage"))
        stage(spark, docs, FOLDER).write.mode("overwrite").parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_keeps_texts_with_letters(steps):
    start, kept = rows(steps["start"]), rows(steps["language ID"])
    assert len(kept) >= 0.99 * len(start) and all(start[i] == r for i, r in kept.items())


def test_one_of_each_group(steps):
    before, kept = rows(steps["language ID"]), rows(steps["SimHash near-dedup"])
    found = [eval(g) for g in groups([(i, r.text) for i, r in before.items()])]
    assert kept.keys() == {component for _, _, component in found} and all(before[i] == r for i, r in kept.items())


def test_leaks_go(spark, steps):
    before, kept = rows(steps["SimHash near-dedup"]), rows(steps["benchmark decontamination"])
    items = [(r.item_id, " ".join(r.text.lower().split())) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    gone = before.keys() - kept.keys()
    for i, r in before.items():
        text = " ".join(r.text.lower().split())
        if any(t in text for _, t in items):
            assert i in gone
    assert all(leaks([(i, before[i].text)], items) for i in list(gone)[:3])


def test_private_data_goes(steps):
    before, after = rows(steps["benchmark decontamination"]), rows(steps["PII"])
    assert before.keys() == after.keys()
    real = {f for r in before.values() for f in FINDS.findall(r.text)}
    assert real and not any(f in r.text for f in real for r in after.values())
    assert all(before[i].text == r.text for i, r in after.items() if not FINDS.search(before[i].text))


def test_the_mix(steps):
    before, after = rows(steps["PII"]), rows(steps["mixing"])
    want = plan([(i, r.text, r.source) for i, r in before.items()])
    taken = Counter()
    for i, r in after.items():
        assert r.taken == len(WORD.findall(r.text)) <= 2 * len(WORD.findall(before[i].text))
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target) < 1.001 for *_, target, s in want)


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, got.collect())) == sorted(map(str, steps["mixing"].collect()))
