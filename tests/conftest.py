import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def iris(spark):
    """150 flowers: four measures with many values, a species with three."""
    draw = random.Random(7)
    rows = [
        (*[round(draw.uniform(0.1, 7.9), 1) for _ in range(4)], ("setosa", "versicolor", "virginica")[i % 3])
        for i in range(150)
    ]
    return spark.createDataFrame(
        rows,
        "sepal_length double, sepal_width double, petal_length double, petal_width double, species string",
    )
