"""The message log's data model, and adapters that read other tables as logs.

Times are 64-bit microseconds since the epoch, so results don't depend on the session's time zone; the total
order inside a partition is (created_at, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _B, _I = T.StringType(), T.LongType(), T.BooleanType(), T.IntegerType()


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MESSAGE = _table(id=_L, transaction_id=_S, queue=_S, partition=_S, created_at=_L, payload=_S, trace_id=_S)
CURSOR = _table(queue=_S, partition=_S, consumer_group=_S, last_at=_L, last_id=_L, lease_until=_L, worker=_S, batch_size=_I, acked=_I, retries=_I)
SUBSCRIPTION = _table(consumer_group=_S, queue=_S, namespace=_S, task=_S, mode=_S, start_at=_L)
QUEUE = _table(name=_S, namespace=_S, task=_S, lease_seconds=_I, retry_limit=_I, delayed_processing=_I, window_buffer=_I, retention_seconds=_I, completed_retention_seconds=_I, max_wait_seconds=_I)
DEAD_LETTER = _table(id=_L, queue=_S, partition=_S, consumer_group=_S, error=_S, retry_count=_I, failed_at=_L)
TRACE = _table(trace_id=_L, message_id=_L, event_type=_S, created_at=_L, data=_S, names=T.ArrayType(_S))
SAMPLE = _table(bucket=_L, worker=_S, queue=_S, measure=_S, n=_L, total=T.DoubleType(), low=T.DoubleType(), high=T.DoubleType(), last=T.DoubleType())


def micros(ts: Column) -> Column:
    """A timestamp without zone, read as UTC, in microseconds."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp"))


def from_events(spark: SparkSession, sf_dir: str, queue: str | None = None) -> DataFrame:
    """The events table as a log: a partition for each user, a queue for each event type (or one queue), the row as payload."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_id").cast("string").alias("transaction_id"),
        (F.lit(queue) if queue else F.col("event_type")).alias("queue"),
        F.col("user_id").cast("string").alias("partition"),
        micros(F.col("ts")).alias("created_at"),
        F.struct("event_type", F.col("value").cast("decimal(18,2)").alias("value"), F.from_json("props", "k int")["k"].alias("k")).alias("payload"),
    )


def from_ndjson(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """A spool of JSON lines as a log; payload is its schema, declared and never inferred row by row."""
    schema = f"id bigint, transactionId string, queue string, partition string, createdAt bigint, payload {payload}"
    rows = spark.read.schema(schema).json(path)
    return rows.select("id", F.col("transactionId").alias("transaction_id"), "queue", F.coalesce("partition", F.lit("Default")).alias("partition"), F.col("createdAt").alias("created_at"), "payload")


def to_ndjson(messages: DataFrame, path: str) -> None:
    """Writes a log as JSON lines, with the names that from_ndjson reads."""
    messages.withColumnsRenamed({"transaction_id": "transactionId", "created_at": "createdAt"}).write.mode("errorifexists").json(path)
