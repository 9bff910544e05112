"""The driver loads ``__spark_entry__`` from another working directory with a plain session:
queries (including the Python-worker range scan) must still run."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {os.path.join(REPO, "__spark_entry__.py")!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
assert E.entry(spark).count() > 0
spark.conf.set("worthrank.rank.partitions", "5")
n = E.queries()["segment_by_restart"](spark, "/root/testdata/sf0.001").count()
print("ROWS", n)
"""


def test_entry_and_range_scan_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="worthrank-driver-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=900)
    assert res.returncode == 0, res.stderr[-3000:]
    assert "ROWS 87" in res.stdout
