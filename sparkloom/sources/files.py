"""Small files and folders on whatever file system the data directory is on."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith(("/", "file:")) else f"{self.root}/{path}")
        return p.getFileSystem(self._conf), p

    def read_json(self, path: str, default=None):
        fs, p = self._at(path)
        if not fs.exists(p):
            return default
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_json(self, path: str, value) -> None:
        """Written beside and renamed over the old file in one step, so that a reader sees the old one or the new one."""
        fs, p = self._at(path)
        tmp = self._jvm.org.apache.hadoop.fs.Path(p.toString() + ".new")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        over = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), self._conf).rename(fs.makeQualified(tmp), fs.makeQualified(p), over)

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
