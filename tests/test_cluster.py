"""Queries on executors of their own, which share no memory with the driver."""

import json
import os
import subprocess
import sys
import tempfile

from .conftest import ROOT, SF

RUN = """
import json, sys
from pyspark.sql import SparkSession
from sparkloom.sources import external
import __spark_entry__
work, name, sf = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{work}/shared", "spark.sql.warehouse.dir": f"{work}/warehouse", "spark.sql.shuffle.partitions": "2"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
external.ROWS_AT_ONCE = 1
print("ROWS", json.dumps([list(r) for r in __spark_entry__.queries()[name](spark, sf).collect()], default=str))
"""


def _rows(name):
    """Rows of a query of the suite in a session on a small cluster."""
    import pyspark

    work, home = tempfile.mkdtemp(), tempfile.mkdtemp()
    for f in os.listdir(pyspark.__path__[0]):  # executors' logs go to work in Spark's home
        if f != "work":
            os.symlink(os.path.join(pyspark.__path__[0], f), os.path.join(home, f))
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_HOME": home, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", RUN, work, name, SF], env=env, cwd=work, capture_output=True, text=True, timeout=300)
    found = [x for x in out.stdout.splitlines() if x.startswith("ROWS ")]
    assert found, out.stderr[-3000:]
    return json.loads(found[0][5:])


def test_external_query_of_the_drivers_database(spark):
    names = {r.n_nationkey: r.n_name for r in spark.read.parquet(f"{SF}/nation.parquet").collect()}
    assert sorted(_rows("external_query")) == sorted([[names[1], "Alice"], [names[7], "Bob"]])
