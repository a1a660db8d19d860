"""Operators whose workers keep something must run where the workers cannot import this package."""

import os
import subprocess
import sys
import tempfile

SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver's path only: workers inherit the environment
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
docs = spark.createDataFrame([(1, "some words under the mit license"), (2, None)], "doc_id long, text string")
def importable(batches):
    import importlib.util
    for batch in batches:
        assert importlib.util.find_spec("siftframe") is None
        yield batch
docs.mapInArrow(importable, docs.schema).collect()
from siftframe.llm import bpe, license_scan, token_files
assert bpe.encode_documents(docs).where("n_tokens > 0").count() == 1
assert license_scan.scan_licenses(docs).where("n_base = 1").count() == 1
assert token_files.round_trip(docs).count() == 2
print("by value: ok")
"""


def test_operators_run_without_the_package_on_the_workers():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    kept = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != root]
    env["PYTHONPATH"] = os.pathsep.join(kept)
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tempfile.mkdtemp(prefix="run-"), env=env,
                          capture_output=True, text=True, timeout=240)
    assert "by value: ok" in done.stdout, done.stderr[-3000:]
