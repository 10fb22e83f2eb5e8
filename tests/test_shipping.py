"""Python workers run the kernels without the package being importable for them."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from tagshift.catalog import QUERIES
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("rows", QUERIES["h01_event_distance"](spark, sys.argv[1]).count())
"""


def test_worker_functions_travel_with_the_job(tmp_path, sf_dir):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "rows " in run.stdout, run.stderr[-2000:]
