"""Starts pipelines on streams: native plans, and stateful ones where exact close, late and gate rules ask for it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.operators import aggregates
from sluice.plans.stream import PlanError, Stream, _apply, emits
from sluice.streaming import commit, stateful


@dataclass
class Handle:
    query: StreamingQuery
    state: str

    def metrics(self) -> dict:
        """Counters over all batches that Spark still remembers."""
        progress = [p.asDict() if hasattr(p, "asDict") else dict(p) for p in self.query.recentProgress]
        ops = [s for p in progress for s in p.get("stateOperators", [])]
        count = lambda k: sum(int(s.get(k, 0)) for s in ops)
        return {"cycles": len(progress), "messages": sum(int(p.get("numInputRows", 0)) for p in progress), "state_updates": count("numRowsUpdated"), "state_removals": count("numRowsRemoved"), "late": count("numRowsDroppedByWatermark")}

    def stop(self) -> None:
        self.query.stop()


def source(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream of messages."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def native(stream: Stream, messages: DataFrame) -> DataFrame:
    """The pipeline in Spark's own streaming operators: watermarks are global and a window is late as a whole.

    Append mode emits a window when the watermark reaches its end plus grace. Reducers are aggregates;
    ordered folds and gates need stateful.windows and stateful.gated.
    """
    plan = stream.compile()
    if plan.gate is not None or (plan.reducer is not None and plan.reducer.kind == "reduce"):
        raise PlanError("gates and ordered folds run in stateful mode")
    rows = stream.rows(messages)
    if plan.window is not None and getattr(plan.window, "on_late", "drop") == "include":
        raise PlanError("late rows are included in strict mode only: Spark's own windows drop them")
    if plan.window is not None:
        w, ts = plan.window, F.timestamp_micros("ts")
        timed = rows.withColumn("_ts", ts).withWatermark("_ts", f"{w.lateness + w.grace} seconds")
        if w.kind == "session":
            window = F.session_window("_ts", f"{w.size} seconds")
        elif w.kind == "sliding":
            window = F.window("_ts", f"{w.size} seconds", f"{w.slide} seconds")
        else:
            window = F.window("_ts", f"{w.size} seconds", f"{w.size} seconds", f"{w.offset % w.size} seconds")
        if plan.reducer is None:
            rows = timed.withColumn("_w", window)
        else:
            named = aggregates.named(plan.reducer.extra, F.col("value"))
            grouped = timed.groupBy("partition", "key", window.alias("_w")).agg(*named)
            fields = [c for c in grouped.columns if c not in ("partition", "key", "_w")]
            rows = grouped.select("partition", "key", "_w", F.struct(*fields).alias("value"))
        rows = rows.withColumn("window_start", F.unix_micros("_w.start")).withColumn("window_end", F.unix_micros("_w.end")).drop("_w", "_ts")
    for step in plan.post:
        rows = _apply(rows, step, F.col("value"))
    return rows


def run(
    stream: Stream, messages: DataFrame, query_id: str, checkpoint: str, sink: str | None = None, foreach: Callable[[DataFrame, int], None] | None = None,
    reset: bool = False, interval: str | None = None, subscription_from: int | None = None, strict: bool = False, on_error: Callable | None = None,
) -> Handle:
    """Registers and starts a pipeline. Without an interval it reads what there is and stops.

    Emits go to the folder `sink`, once for each batch, or to `foreach` (at least once; an exception fails the
    batch, which is run again). strict uses the stateful operators.
    """
    plan = stream.compile()
    spark = messages.sparkSession
    state = commit.register(spark, checkpoint, query_id, plan.hash, reset)
    if subscription_from is not None:
        messages = messages.filter(F.col("created_at") >= subscription_from)
    if plan.gate is not None:
        rows = stateful.gated(stream, messages, interval is not None)
    elif strict and plan.window is not None and plan.reducer is not None:
        rows = stateful.windows(stream, messages, interval is not None)
    else:
        rows = native(stream, messages)
    if plan.sink is not None and plan.sink.kind == "sink":
        rows = emits(rows, plan.sink)
    action = foreach or (plan.sink.fn if plan.sink is not None and plan.sink.kind == "foreach" else None) or commit.parquet_sink(sink)
    if on_error is not None:
        inner = action

        def action(batch, batch_id):  # noqa: F811
            try:
                inner(batch, batch_id)
            except Exception as e:
                on_error(e)
                raise

    writer = rows.writeStream.foreachBatch(action).option("checkpointLocation", f"{checkpoint}/spark").queryName(query_id)
    writer = writer.outputMode("append")
    return Handle((writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start(), state)


__all__ = ["Handle", "native", "run", "source"]
