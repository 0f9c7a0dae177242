"""Windowed streams over event tables: the same functions run on streams and on batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

DELAY = "10 minutes"


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; DATETIME columns are read as UTC."""
    return df.withColumn(col, F.col(col).cast("timestamp")) if isinstance(df.schema[col].dataType, T.TimestampNTZType) else df


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of Parquet files; ``path`` may be one file, then a stream of its folder filtered to it."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return r.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_dir(spark, path) else r.parquet(path)


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def tumbling(df: DataFrame, size: str, keys: list[str], *aggs, ts: str = "ts", slide: str | None = None, delay: str = DELAY) -> DataFrame:
    """Aggregates of tumbling (or, with ``slide``, sliding) windows; a watermark bounds the state of streams."""
    df = event_time(df, ts)
    df = df.withWatermark(ts, delay) if df.isStreaming else df
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = df.groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, gap: str, keys: list[str], *aggs, ts: str = "ts", delay: str = DELAY) -> DataFrame:
    """Aggregates of session windows that end ``gap`` after their last event."""
    df = event_time(df, ts)
    df = df.withWatermark(ts, delay) if df.isStreaming else df
    out = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def dedup(df: DataFrame, keys: list[str], ts: str = "ts", delay: str = DELAY) -> DataFrame:
    """First row of each key: on streams within the watermark, as an insert id works."""
    df = event_time(df, ts)
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def running(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, n, total)``: rows and sum of ``value`` so far of each key that a batch has rows of.

    State of one count and one sum a key is kept between the batches of a stream; a batch
    table gives the totals.
    """
    rows = df.select(F.col(key).alias(key), F.col(value).cast("double").alias("v"))
    if not df.isStreaming:
        return rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))
    kind = rows.schema[key].dataType.simpleString()

    def add(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["v"].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [round(total, 4)]})

    return rows.groupBy(key).applyInPandasWithState(add, f"`{key}` {kind}, n long, total double", "n long, total double", "update", "NoTimeout")


def run_once(stream: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what there is and gives the sink's contents.

    The sink is Parquet below the checkpoint folder, written by the executors: what each
    batch adds for ``append`` and ``update``, what the last one gives for ``complete``.
    """
    spark = stream.sparkSession
    name = f"s_{uuid.uuid4().hex}"
    base = checkpoint or shared_folder(spark)
    out = f"{base}/{name}-out"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").start(out).awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    paths: dict[str, None] = {}

    def write(batch: DataFrame, number: int) -> None:
        path = out if mode == "complete" else f"{out}/{number}"
        batch.write.mode("overwrite").parquet(path)  # a batch that is repeated replaces itself
        paths[path] = None

    w.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)
