"""Executors need not have this package: what runs on them travels by value."""

import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).parents[2])
CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from colprism.llm.registry import QUERIES
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {folder!r}).getOrCreate())

def absent(_):
    try:
        import colprism
    except ModuleNotFoundError:
        return [True]
    return [False]

assert spark.sparkContext.parallelize([0], 1).mapPartitions(absent).collect() == [True]
for name in {names!r}:
    print(name, len(QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
"""


def test_without_the_package(tmp_path):
    names = ["op2_language_id", "op5_hmm_score", "op11_prefix_trie", "op12_packing", "op13_filter_audit"]
    code = CODE.format(repo=REPO, folder=str(tmp_path / "shared"), names=names)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split("\n")) >= len(names)
