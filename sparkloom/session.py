"""Spark session settings that the engine relies on."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent

#: Settings that change results, set on any session the engine is given.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.timestampType": "TIMESTAMP_LTZ",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    "spark.sql.cte.recursion.level.limit": "1000",
}
#: Settings that bound a task's memory, set on sessions that have none of their own: with Spark's 64 MB of compressed
#: shuffle data a task sorts and hashes many times as much, once for each join and aggregate of its stage.
BOUNDS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}
#: Settings for speed, only for sessions made here.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME.items():
        spark.conf.set(k, v)
    for k, v in BOUNDS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def create_session(app: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``master`` is left to spark-submit where it is None."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**TUNING, **conf}.items():
        b = b.config(k, v)
    return configure(b.getOrCreate())


def is_local(spark: SparkSession) -> bool:
    """Whether tasks run in the driver's own process."""
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one for local masters where that is unset, an error for others."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return base.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless they find it on their path already."""
    path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    sc = spark.sparkContext
    if str(_ROOT) in path or os.getcwd() == str(_ROOT) and sc.master.startswith("local") or getattr(sc, "_sparkloom", None):
        return
    file = os.path.join(tempfile.mkdtemp(prefix="sparkloom-ship-"), "sparkloom.zip")
    with zipfile.ZipFile(file, "w") as z:
        for f in sorted((_ROOT / "sparkloom").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    sc.addPyFile(file)
    sc._sparkloom = True
