"""Idempotent commits and the deployment guard of a stream."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ConfigChanged(ValueError):
    """A stream was started with another structure than its state was made by."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def register(spark: SparkSession, checkpoint: str, query_id: str, config_hash: str, reset: bool = False) -> str:
    """`new`, `resumed` or `reset`. State made by another structure is an error unless reset, which deletes it."""
    fs, folder = _fs(spark, checkpoint)
    _, meta = _fs(spark, f"{checkpoint}/stream.json")
    jvm = spark.sparkContext._jvm
    state = "new"
    if fs.exists(meta):
        source = fs.open(meta)
        held = json.loads(jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        source.close()
        if held["hash"] == config_hash and not reset:
            return "resumed"
        if not reset:
            raise ConfigChanged(f"{query_id} was made by another structure; reset deletes its state")
        fs.delete(folder, True)
        state = "reset"
    out = fs.create(meta, True)
    out.write(bytearray(json.dumps({"query": query_id, "hash": config_hash}).encode()))
    out.close()
    return state


def parquet_sink(path: str, key: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch once: a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(list(key)) if key else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def fold_table(spark: SparkSession, path: str, step: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a table (cursors, counters) by rewriting: each batch makes a version from the newest one before it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        fs, folder = _fs(spark, path)
        versions = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder)) if fs.exists(folder) else []
        older = [v for v in versions if v < batch_id]
        now = spark.read.parquet(f"{path}/v={older[-1]}") if older else None
        step(now, batch).withColumn("_batch", F.lit(batch_id)).drop("_batch").write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return write


def newest(spark: SparkSession, path: str) -> DataFrame:
    fs, folder = _fs(spark, path)
    last = max(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder))
    return spark.read.parquet(f"{path}/v={last}")
