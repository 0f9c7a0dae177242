"""Helpers shared by the operators: shared work folder, written tables, size-checked broadcast."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow decision table (an id, a digest) is broadcast.  Beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


_made: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent, a local master gets a temporary folder; any other
    master is refused, as no folder is known that its executors share.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sparkloom-"))
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/sparkloom-{uuid.uuid4().hex}"
    for made in _made:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the folders that operators made inside: for results that have been written elsewhere by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            drop_path(spark, path)


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back: cuts the lineage and survives lost executors."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` texts for what is run inside: bounds the memory of Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a written table that is no longer read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as the build side of a join: broadcast if its counted ``rows`` allow it, else shuffled and hashed."""
    return F.broadcast(df) if rows <= limit else df.hint("shuffle_hash")


def col(name: str) -> Column:
    """The column called exactly ``name``, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


class Sealed:
    """A table under column names of its own (``c0``, ``c1``, ...), so that no column an operator adds clashes with it."""

    def __init__(self, df: DataFrame):
        self.names, self.schema = df.columns, df.schema
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def __contains__(self, name: str) -> bool:
        return name.lower() in [n.lower() for n in self.names]

    def col(self, name: str) -> Column:
        """The column called ``name`` before sealing."""
        low = [n.lower() for n in self.names]
        return F.col(f"c{self.names.index(name) if name in self.names else low.index(name.lower())}")

    def open(self, df: DataFrame, *more: Column, drop: str = "") -> DataFrame:
        """``df`` under the names before sealing, without the column ``drop``, with the columns ``more`` behind."""
        return df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(self.names) if n.lower() != drop], *more)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without input columns that clash with names an operator adds (case does not count)."""
    taken = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in taken]
    return df.select([col(c) for c in df.columns if c not in clash]) if clash else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
