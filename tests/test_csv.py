"""CSV in two lanes: what fits the schema, and every line that does not."""

import pytest
from pyspark.sql import functions as F

from colprism.sources import tables

SCHEMA = "id int, name string, price double"


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "csv"
    place.mkdir()
    (place / "a.csv").write_text('id,name,price\n1,plain,2.5\n2,"a, b ""c""",\nx,bad id,1\n4,few\n5,many,1,2\n6,"",3\n')
    (place / "b.csv").write_text("id,name,price\n7,é,1e3\n8,z,n/a\n")
    (place / "c.csv").write_text("id,name,price\n")
    return str(place)


def test_two_lanes(spark, folder):
    rows, rescued = tables.read_csv_rescued(spark, folder, SCHEMA)
    assert sorted((r.id, r.name, r.price) for r in rows.collect()) == [(1, "plain", 2.5), (2, 'a, b "c"', None), (6, None, 3.0), (7, "é", 1000.0)]
    assert sorted(r.record for r in rescued.collect()) == ["4,few", "5,many,1,2", "8,z,n/a", "x,bad id,1"]
    counts = {r.file.rsplit("/", 1)[1]: r.lines for r in tables.rescued_counts(rescued).collect()}
    assert counts == {"a.csv": 3, "b.csv": 1}


def test_a_line_keeps_its_lane_whatever_is_read(spark, folder):
    rows, rescued = tables.read_csv_rescued(spark, folder, SCHEMA)
    assert rows.count() == rows.select("name").count() == rows.select("id").collect().__len__() == 4
    assert rescued.count() == 4 and rescued.select("file").count() == 4


def test_files_are_split(spark, tmp_path):
    spark.range(60_000).select("id", F.concat(F.lit("name "), "id").alias("name"), F.lit(1.5).alias("price")).coalesce(1).write.csv(
        str(tmp_path / "one"), header=True
    )
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows, rescued = tables.read_csv_rescued(spark, str(tmp_path / "one"), SCHEMA)
        assert rows.rdd.getNumPartitions() > 4
        assert rows.count() == 60_000 and rescued.count() == 0
        assert tables.read_csv_rescued(spark, str(tmp_path / "one"), SCHEMA, multi_line=True)[0].rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_with_line_ends_on_request(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,name,price\n1,"two\nlines",2\n')
    rows, rescued = tables.read_csv_rescued(spark, str(tmp_path / "m.csv"), SCHEMA, multi_line=True)
    assert [r.name for r in rows.collect()] == ["two\nlines"] and rescued.count() == 0
