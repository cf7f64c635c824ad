"""The package reaches the executors when the driver runs in another folder."""

import os
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {top!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("rows", __spark_entry__.queries()["slot_state"](spark, {folder!r}).count())
"""


def test_scans_run_from_another_folder(tmp_path, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(top=TOP, folder=folder)], cwd=tmp_path, env=env, capture_output=True, text=True,
                          timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]
