"""Queries where executors know nothing of the library: a process of its own, started elsewhere, without PYTHONPATH."""

import json
import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parents[2])

RUN = """
import json, sys, tempfile
sys.path.insert(0, sys.argv[1])  # the driver's path alone
from pyspark.sql import SparkSession
import __spark_entry__
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="fungo-tests-")).config("spark.driver.memory", "3g").getOrCreate())
try:
    spark.sparkContext.parallelize([1], 1).map(lambda x: __import__("fungo")).count()
    raise SystemExit("executors can import the library")
except Exception:
    pass
from fungo.llm import queries
found = {}
for name, q in {**queries.queries(), "pipeline": __spark_entry__.queries()["pipeline"]}.items():
    found[name] = len(q(spark, "/root/testdata/sf0.001").collect())
print("FOUND", json.dumps(found))
"""


def test_every_query_runs_where_executors_lack_the_library(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, "-c", RUN, REPO], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    line = [x for x in done.stdout.splitlines() if x.startswith("FOUND")]
    assert line, done.stderr[-3000:] + done.stdout[-500:]
    assert all(json.loads(line[0][6:]).values())
