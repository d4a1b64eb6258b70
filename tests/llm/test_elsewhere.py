"""Tasks need not have this package: the driver is started in another folder, and only it can import quantiva."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as E
from quantiva.session import get_spark
from pyspark.sql import functions as F
spark = get_spark(master="local[4]", shuffle_partitions=4)
found = spark.range(1).mapInArrow(lambda it: (b for b in it if __import__("importlib").util.find_spec("quantiva")), "id bigint").count()
print("in tasks:", found)
for k in sys.argv[2:]:
    print(k, len(E.queries()[k](spark, "/root/testdata/sf0.001").collect()) > 0)
"""
QUERIES = ["op3_ann", "op4_language_id", "op7_decontaminate", "op8_byte_bpe", "op10_quality", "op12_periodic_runs", "op13_whitening"]


def test_queries_of_a_driver_in_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    keep = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT]
    if keep:
        env["PYTHONPATH"] = os.pathsep.join(keep)
    done = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, *QUERIES], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.split("\n")[:-1] == ["in tasks: 0", *[f"{k} True" for k in QUERIES]]
