"""A raw table goes in, the type of each column comes out, also from a saved pipeline."""

import pytest
from pyspark.sql import functions as F

from colprism.plans import classify, semantic
from colprism.plans.extract import featurize_table
from colprism.sources import tables

TYPES = {"size": "numeric", "price": "numeric", "kind": "categorical", "day": "datetime", "note": "sentence", "page": "url"}


@pytest.fixture(scope="module")
def shop(spark):
    rows = spark.range(60).select(
        (F.col("id") * 7 % 31).alias("size"),
        (F.col("id") * 1.25 + 3).alias("price"),
        F.element_at(F.array(F.lit("red"), F.lit("blue"), F.lit("green")), (F.col("id") % 3 + 1).cast("int")).alias("kind"),
        F.concat(F.lit("2020-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")).alias("day"),
        F.concat(F.lit("this is a rather long note that says something about item number "), "id").alias("note"),
        F.concat(F.lit("http://shop.example/item"), "id").alias("page"),
    )
    return rows.repartition(1).cache()


@pytest.fixture(scope="module")
def labelled(shop):
    named = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return featurize_table(shop).withColumn(semantic.LABEL, named[F.col("Attribute_name")]).coalesce(1).cache()


def types(table, model):
    return {r.Attribute_name: r.predicted for r in semantic.predict_types(table, model).collect()}


def test_types_of_a_raw_table_from_a_saved_pipeline(shop, labelled, tmp_path):
    model = semantic.fit_types(labelled, classify.logistic(100.0, 6, iterations=40))
    assert types(shop, model) == TYPES
    tables.save_pipeline(model, str(tmp_path / "model"))
    again = tables.load_pipeline(str(tmp_path / "model"))
    assert isinstance(again.stages[0], semantic.ColumnFeatures)
    assert types(shop, again) == TYPES
    other = shop.select(F.col("size").alias("height"), F.col("page").alias("link"), F.lit("ümlaut").alias("odd"))
    found = types(other, again)
    assert found["link"] == "url" and set(found) == {"height", "link"}  # the filter is a stage of the pipeline


def test_bad_rows_and_unknown_types_teach_nothing(shop, labelled, spark):
    odd = labelled.limit(1).withColumn("Attribute_name", F.lit("ü")).withColumn(semantic.LABEL, F.lit("url"))
    unknown = labelled.limit(1).withColumn(semantic.LABEL, F.lit("no such type"))
    forest = classify.forest(3, 4)
    plain = semantic.fit_types(labelled, forest)
    more = semantic.fit_types(labelled.union(odd).union(unknown).coalesce(1), forest)
    assert more.stages[-2].numFeatures == plain.stages[-2].numFeatures
    kept = semantic.fit_types(labelled, forest, drop_bad=False, features=semantic.ColumnFeatures(columns=["kind", "odd"]))
    assert set(types(shop.withColumn("odd", F.lit("ü")), kept)) == {"kind", "odd"}


def test_a_machine_of_a_grid_as_the_last_stage(shop, labelled, tmp_path):
    from pyspark.ml import PipelineModel

    from colprism.operators.prep import label_code
    from colprism.plans import gridfit

    train = labelled.withColumn("label", label_code(F.col(semantic.LABEL)).cast("double")).withColumn("fold", F.lit(1))
    vectors = classify.fit_features(train, semantic.default_layout())
    rows = gridfit.prepared(vectors.transform(train), "label", "fold", F.lit(False), "features")
    fit = gridfit.fit_grid(rows, [gridfit.Machine("logistic", 100.0, iterations=30)])
    stages = [semantic.ColumnFeatures(), *vectors.stages, gridfit.MachineModel.of(fit, 0, 0), semantic.label_namer()]
    tables.save_pipeline(PipelineModel(stages=stages), str(tmp_path / "model"))
    assert types(shop, tables.load_pipeline(str(tmp_path / "model"))) == TYPES
