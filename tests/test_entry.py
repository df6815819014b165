"""The entry module in processes of its own."""
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

ELSEWHERE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
queries = __spark_entry__.queries()
assert queries["template_coverage"](spark, "/root/testdata/sf0.001").count() > 0
assert queries["structural_distances"](spark, "/root/testdata/sf0.001").count() > 0
spark.stop()
again = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert queries["template_coverage"](again, "/root/testdata/sf0.001").count() > 0
"""


def test_queries_run_where_workers_cannot_find_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
