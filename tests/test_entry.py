"""The contract's queries must run whatever the working directory is."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("contract", {os.path.join(ROOT, "__spark_entry__.py")!r})
contract = importlib.util.module_from_spec(spec)
spec.loader.exec_module(contract)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", len(contract.entry(spark).collect()))
"""


def test_flagship_runs_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout and int(done.stdout.split("ROWS")[1].split()[0]) > 0, done.stderr[-2000:]
