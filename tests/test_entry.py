"""The flagship entry must run in a small heap."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("rows", e.entry(spark).count())
spark.stop()
"""


def test_entry_runs_in_one_gigabyte():
    out = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYSPARK_GATEWAY_PORT"})
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split("rows")[1]) > 1000
