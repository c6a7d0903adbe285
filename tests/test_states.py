"""Merged states of the parts of a table are the profile of the whole."""

import math

import pytest
from pyspark.sql import functions as F

from colprism.operators import states
from colprism.operators.profile import profile
from colprism.operators.sampling import sample_rows
from colprism.sources.tables import union_all


def table(spark):
    return (
        spark.range(1200)
        .select(
            "id",
            F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") * 0.37 - 50).alias("x"),
            F.when(F.col("id") % 13 == 0, float("nan")).otherwise(F.col("id") % 7 + 1e9).alias("f"),
            F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("v"), F.col("id") % 300)).alias("t"),
            (F.col("id") % 2 == 0).alias("b"),
            F.lit(None).cast("int").alias("e"),
            (F.lit(10**9) + F.col("id")).alias("w"),
            F.array(F.col("id") % 3).alias("a b::c"),
        )
        .cache()
    )


def close(x, y):
    if x is None or y is None:
        return x is y
    return (math.isnan(x) and math.isnan(y)) or math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-9)


def same(got, want):
    got, want = ({r.name: r.asDict() for r in rows} for rows in (got, want))
    assert got.keys() == want.keys()
    for name in want:
        for k, v in want[name].items():
            if k.startswith("distinct"):
                assert (got[name][k] or 0) == pytest.approx(v or 0, rel=0.05)
            elif k != "name":
                assert close(got[name][k], v), (name, k, got[name][k], v)


@pytest.mark.parametrize("semantics", ["spark", "pandas"])
def test_merged_parts_are_the_whole(spark, semantics, tmp_path):
    df = table(spark)
    parts = [df.where(F.col("id") % 4 == i) for i in range(4)] + [df.where("id < 0")]
    found = []
    for i, part in enumerate(parts):  # stored day by day
        path = str(tmp_path / f"day{i}")
        states.profile_state(part, semantics=semantics).write.parquet(path)
        found.append(spark.read.parquet(path))
    whole = states.merged(*found)
    same(states.finished(whole).collect(), profile(df, semantics=semantics).collect())
    # In another grouping, and in one go.
    pair = states.merged(states.merged(found[0], found[3]), states.merged(found[4], found[2], found[1]))
    same(states.finished(pair).collect(), states.finished(whole).collect())
    same(states.finished(states.profile_state(df, semantics=semantics)).collect(), profile(df, semantics=semantics).collect())
    want = sorted((r.column, r.value, r.rn) for r in sample_rows(df, 5).collect())
    assert sorted((r.column, r.value, r.rn) for r in states.samples_of(whole).collect()) == want
    assert states.finished(whole, use_legacy_names=True).columns == profile(df, use_legacy_names=True).columns


def test_columns_that_come_and_go(spark):
    df = table(spark)
    whole = states.merged(states.profile_state(df.select("id", "x"), samples=2), states.profile_state(df.select("x", "t"), samples=2))
    got = {r.name: r for r in states.finished(whole).collect()}
    assert got["id"]["count"] == 1200 and got["x"]["count"] == 2 * df.where("x IS NOT NULL").count() and got["t"]["count"] == 1200
    assert union_all(*[states.samples_of(whole)]).groupBy("column").count().where("count <> 2").count() == 0
