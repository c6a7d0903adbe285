"""Distinct counts and samples from one shuffle equal those that are worked out apart."""

import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from colprism.operators.profile import distinct_counts
from colprism.operators.sampling import counts_and_samples, sample_rows
from colprism.plans.extract import extract_features


def odd_table(spark):
    draw = random.Random(6)
    rows = []
    for i in range(900):
        f = draw.choice([0.0, -0.0, math.nan, math.inf, None, draw.randrange(400) / 7])
        rows.append(
            (
                i, f, draw.choice([None, "", "NaN", "x" * draw.randrange(200), f"v{i}"]), draw.choice([True, False, None]),
                datetime.date(2020, 1, 1) + datetime.timedelta(days=draw.randrange(300)), [draw.randrange(9)] * draw.randrange(3),
                draw.choice([b"", b"a\x00", None]), None, 2**53 + draw.randrange(3), f"z{draw.randrange(50)}",
            )
        )
    kind = "a long, f double, t string, b boolean, d date, l array<int>, n binary, e string, w long, `o.d::d name` string"
    return spark.createDataFrame(rows, kind).repartition(5).cache()


@pytest.mark.parametrize("semantics", ["spark", "pandas"])
@pytest.mark.parametrize("keep_null", [False, True])
def test_equal_to_what_is_worked_out_apart(spark, semantics, keep_null):
    df = odd_table(spark)
    for n in (1, 5, 40):
        got = counts_and_samples(df, n, semantics=semantics, keep_null=keep_null).collect()
        want = sample_rows(df, n, keep_null=keep_null).collect()
        assert sorted((r.column, r.value or "", r.rn) for r in got) == sorted((r.column, r.value or "", r.rn) for r in want)
    counts = {df.columns[r.pos]: r.distinct for r in distinct_counts(df, None, semantics).collect()}
    assert {(r.column, r.distinct) for r in got} == {(c, counts.get(c, 0)) for c in {r.column for r in got}}


def scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"Relation \[", plan))


def test_three_scans(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert scans(extract_features(df)) <= 3


def test_wide_table(spark):
    df = spark.range(2000).select(
        *[(F.xxhash64("id", F.lit(i)) % (i * 50 + 3)).cast("string" if i % 3 == 0 else "long").alias(f"c{i}") for i in range(150)]
    )
    df = df.cache()
    df.count()
    rows = extract_features(df).collect()
    assert len(rows) == 150
    by = {r.name: r for r in rows}
    assert by["c0"].distinct == df.select("c0").distinct().count() and by["c149"].distinct == df.select("c149").distinct().count()
