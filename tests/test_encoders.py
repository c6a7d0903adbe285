"""Bigrams of many rows, dealt out by row and never by bigram."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from colprism.operators import encoders


@pytest.mark.parametrize("sent", [1 << 18, 2])
def test_encoded_like_python(spark, monkeypatch, sent):
    monkeypatch.setattr(encoders, "_SENT", sent)
    texts = ["abab", "", None, "b", "xab", "abab"]
    rows = [(i % 5, t) for i, t in enumerate(texts)]  # the last one has the id of the first
    df = spark.createDataFrame(rows, "id long, t string")
    vocabulary = encoders.gram_vocabulary(df.where("t <> 'xab'"), "t")
    number = {r.gram: r.gram_index for r in vocabulary.collect()}
    want = Counter()
    for i, t in rows:
        t = "nan" if t is None else t
        want.update((i, number[t[p : p + 2]]) for p in range(len(t) - 1) if t[p : p + 2] in number)
    got = encoders.encode_grams(df, "id", "t", vocabulary).collect()
    assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == len(want)


def test_a_task_counts_the_bigrams_of_a_bounded_number_of_characters(spark, monkeypatch):
    """Counted where they were read, the bigrams of one small file were the counts of one task."""
    monkeypatch.setattr(encoders, "_CHARS", 1000)
    df = spark.range(1000).select("id", F.lit("abcdefghij").alias("t")).coalesce(1)
    spread = encoders.gram_counts(df, "id", "t").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 10 and max(r["count"] for r in spread) < 2000
    plan = encoders.encode_grams(df, "id", "t", encoders.gram_vocabulary(df, "t"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
