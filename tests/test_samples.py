import pytest
from pyspark.sql import functions as F

from colprism.fixed_values import SAMPLE_FEATURE_NAMES
from colprism.operators.longform import melt
from colprism.operators.samplefeatures import sample_features
from colprism.operators.sampling import fill_up, sample_values
from colprism.plans.extract import extract_features, featurize_table


def test_three_samples_per_column(iris):
    result = sample_values(iris, n=3)
    assert result.columns == ["column", "value"]
    assert result.count() == 15


def test_too_few_values(iris):
    assert sample_values(iris, n=5).count() == 23


def test_samples_are_the_smallest_hashes_whatever_the_size(spark):
    # Enough values for the hash bound to cut, and one value that fills a third of the rows.
    df = spark.range(60000).select(
        F.col("id").cast("string").alias("many"),
        F.when(F.col("id") < 20000, F.lit("hot")).otherwise(F.concat(F.lit("v"), "id")).alias("skewed"),
        F.pmod("id", F.lit(3)).alias("few"),
        F.when(F.col("id") == 7, F.lit("only")).alias("rare"),
    )
    got = {(r["column"], r["value"]) for r in sample_values(df, 5).collect()}
    cells = melt(df, keep_null=False).distinct().toPandas()
    import hashlib

    cells["h"] = [
        hashlib.md5(f"{c}|{v}".encode()).hexdigest() for c, v in zip(cells["column"], cells["value"])
    ]
    want = cells.sort_values("h").groupby("column").head(5)
    assert got == set(zip(want["column"], want["value"]))


def test_first_seen_samples(spark):
    df = spark.range(50000).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") * 7919 % 20011).cast("string")).alias("v"),
    )
    got = [r["value"] for r in sample_values(df, 4, ["v"], order_by="id").collect()]
    assert sorted(got) == sorted(["hot", "7919", "15838", str(4 * 7919 % 20011)])


def test_null_as_a_value(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "c string")
    assert {r["value"] for r in sample_values(df, 5).collect()} == {"a"}
    assert {r["value"] for r in sample_values(df, 5, keep_null=True).collect()} == {"a", None}


@pytest.mark.parametrize("size,want", [(0, []), (1, list("aaaaa")), (3, list("abcab")), (7, list("abcde"))])
def test_fill_up(spark, size, want):
    items = F.array(*[F.lit(x) for x in "abcdefg"[:size]]).cast("array<string>")
    assert spark.range(1).select(fill_up(items, 5)).first()[0] == want


def test_sample_features_legacy_layout(iris):
    result = sample_features(sample_values(iris), use_legacy_names=True)
    assert result.columns == ["column", *SAMPLE_FEATURE_NAMES.values()]
    rows = result.collect()
    assert len(rows) == 5
    assert all(r[f"sample_{i}"] is not None for r in rows for i in range(1, 6))


def test_flags_need_three_votes(spark):
    df = spark.createDataFrame(
        [("u", v) for v in ("http://a.b", "https://c.d/e", "ftp://x.y", "x", "y")]
        + [("t", v) for v in ("http://a.b", "https://c.d/e", "x", "y", "z")],
        "column string, value string",
    )
    got = {r["column"]: r["is_url"] for r in sample_features(df).collect()}
    assert got == {"u": True, "t": False}


def test_spread_over_samples_and_over_the_table(spark):
    df = spark.createDataFrame([("p", "a b"), ("p", "c"), ("q", "d e f g")], "column string, value string")
    own = {r["column"]: r for r in sample_features(df, 2).collect()}
    assert own["p"]["mean_word_count"] == 1.5 and own["p"]["std_word_count"] == 0.5
    table = sample_features(df, 2, spread="table").collect()
    assert {r["mean_word_count"] for r in table} == {(3 + 8) / 2}
    assert table[0]["std_word_count"] == pytest.approx(((3 - 5.5) ** 2 + (8 - 5.5) ** 2) ** 0.5)


def test_extract_features_one_row_per_column(iris, spark):
    got = extract_features(iris, use_legacy_names=True)
    assert got.count() == 5
    assert got.columns[0] == "Attribute_name" and len(got.columns) == 31
    empty = extract_features(spark.createDataFrame([(None,)], "c string")).collect()
    assert empty[0]["is_url"] is False and empty[0]["sample_0"] is None


def test_featurize_table(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "id int, v string")
    row = {r["Attribute_name"]: r for r in featurize_table(df, order_by="id").collect()}["v"]
    assert [row[f"sample_{i}"] for i in range(1, 6)] == ["b", "a", "b", "a", "b"]
    assert row["total_vals"] == 3 and row["num_of_dist_val"] == 2
