"""Headline queries: one warm-up and the median of three timed runs each, as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from catalog.queries import QUERIES
from colprism.operators.profile import profile
from colprism.operators.scaleout import replicate

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "profile_lineitem",
    "profile_approx_lineitem",
    "sample_values_customer",
    "column_features_customer",
    "column_features_orders",
    "value_features_documents",
    "knn_combined",
]
SERIES = [1, 2, 4, 8, 16, 32]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # The neighbour join moves little data and computes a lot on it: keep its tasks apart.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        # Plans are built anew for every run; skip recording the call site of every column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(make, runs: int) -> float:
    taken = []
    for _ in range(runs):
        started = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - started)
    return round(statistics.median(taken), 3)


def shape(df: DataFrame) -> dict[str, int]:
    """File scans and shuffles in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {
        "scans": plan.count("FileScan"),
        "shuffles": plan.count("Exchange hashpartitioning")
        + plan.count("Exchange rangepartitioning")
        + plan.count("Exchange RoundRobinPartitioning")
        + plan.count("Exchange SinglePartition"),
    }


def main() -> None:
    spark = session()
    times, plans = {}, {}
    for name in HEADLINE:
        make = lambda: QUERIES[name](spark, FOLDER)
        plans[name] = shape(make()) | {"rows": make().count()}  # also the warm-up
        times[name] = seconds(make, 3)
    lineitem = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    for copies in SERIES:
        times[f"profile_lineitem_x{copies}"] = seconds(
            lambda: profile(replicate(lineitem, copies).repartition(int(CPUS) * 2)), 1
        )
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times[n] for n in HEADLINE), 3),
                "unit": "sec",
                "queries": times,
                "plans": plans,
                "sf": os.path.basename(FOLDER.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
