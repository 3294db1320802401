"""A fluent, immutable pipeline description that becomes one DataFrame plan, on bounded logs and on streams.

Callables get and return Columns: `lambda m: m["payload"]["value"] > 3` is a Catalyst expression. With
`returns="<type>"` a callable is opaque Python over plain values and runs as a vectorised UDF.

Before the reducer every operator reads the original message, whatever stands before it (two maps don't
compose), and key_by applies after all of them. After the reducer each operator reads the value before it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.scalars import config_hash, iso_millis
from sluice.operators import aggregates, windows


class PlanError(ValueError):
    """The chain breaks a rule of the pipeline."""


@dataclass(frozen=True)
class Step:
    kind: str
    fn: Callable | None = None
    config: dict = field(default_factory=dict)
    extra: Any = None


@dataclass(frozen=True)
class Compiled:
    pre: tuple[Step, ...]
    key_by: Step | None
    window: windows.Window | None
    reducer: Step | None
    gate: Step | None
    post: tuple[Step, ...]
    sink: Step | None
    hash: str


def _opaque(fn: Callable, returns: str) -> Callable[[Column], Column]:
    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([fn(json.loads(v).get("v")) for v in values], dtype=object)

    return lambda c: run(F.to_json(F.struct(c.alias("v"))))  # structs of any depth travel as JSON


@dataclass(frozen=True)
class Stream:
    queue: str
    options: dict = field(default_factory=dict)
    steps: tuple[Step, ...] = ()

    @classmethod
    def from_(cls, queue: str, **options) -> Stream:
        return cls(queue, options)

    from_queue = from_

    def _with(self, step: Step) -> Stream:
        return replace(self, steps=(*self.steps, step))

    def map(self, fn: Callable, returns: str | None = None) -> Stream:
        return self._with(Step("map", _opaque(fn, returns) if returns else fn))

    def filter(self, predicate: Callable, opaque: bool = False) -> Stream:
        return self._with(Step("filter", _opaque(predicate, "boolean") if opaque else predicate))

    def flat_map(self, fn: Callable, returns: str | None = None) -> Stream:
        return self._with(Step("flatMap", _opaque(fn, returns) if returns else fn))

    def key_by(self, fn: Callable) -> Stream:
        return self._with(Step("keyBy", fn))

    def _window(self, kind: str, size: int, **options) -> Stream:
        window = windows.Window(kind, size, **options)
        return self._with(Step("window", None, window.config(), window))

    def window_tumbling(self, seconds: int, grace_period: float = 0, idle_flush_ms: int = 5000, event_time=None, allowed_lateness: float = 0, on_late: str = "drop") -> Stream:
        return self._window("tumbling", seconds, grace=grace_period, idle_flush_ms=idle_flush_ms, event_time=event_time, lateness=allowed_lateness, on_late=on_late)

    def window_sliding(self, size: int, slide: int, grace_period: float = 0, idle_flush_ms: int = 5000, event_time=None, allowed_lateness: float = 0, on_late: str = "drop") -> Stream:
        return self._window("sliding", size, slide=slide, grace=grace_period, idle_flush_ms=idle_flush_ms, event_time=event_time, lateness=allowed_lateness, on_late=on_late)

    def window_session(self, gap: int, grace_period: float = 0, idle_flush_ms: int = 1000, event_time=None, allowed_lateness: float = 0, on_late: str = "drop") -> Stream:
        return self._window("session", gap, grace=grace_period, idle_flush_ms=idle_flush_ms, event_time=event_time, lateness=allowed_lateness, on_late=on_late)

    def window_cron(self, every: str, grace_period: float = 0, idle_flush_ms: int = 30000, event_time=None, allowed_lateness: float = 0, on_late: str = "drop") -> Stream:
        if every not in windows.CALENDAR:
            raise PlanError(f"every is one of {', '.join(windows.CALENDAR)}")
        size, offset = windows.CALENDAR[every]
        return self._window("cron", size, offset=offset, grace=grace_period, idle_flush_ms=idle_flush_ms, event_time=event_time, lateness=allowed_lateness, on_late=on_late)

    def reduce(self, step: Callable, initial: Column) -> Stream:
        return self._with(Step("reduce", step, extra=initial))

    def aggregate(self, spec: dict) -> Stream:
        return self._with(Step("aggregate", None, {"fields": list(spec)}, spec))

    def gate(self, gate) -> Stream:
        return self._with(Step("gate", gate))

    def to(self, queue: str, partition: str | Callable | None = None) -> Stream:
        return self._with(Step("sink", partition if callable(partition) else None, {"queue": queue}, partition))

    def foreach(self, fn: Callable) -> Stream:
        return self._with(Step("foreach", fn))

    def compile(self) -> Compiled:
        """Checks the chain's rules and sorts its steps into stages."""
        pre, post, key_by, window, reducer, gate, sink = [], [], None, None, None, None, None
        for step in self.steps:
            if sink is not None:
                raise PlanError("nothing follows a sink")
            if step.kind == "keyBy":
                if key_by is not None:
                    raise PlanError("there is one key_by at most")
                if reducer is not None or gate is not None:
                    raise PlanError("key_by comes before the reducer or gate")
                key_by = step
            elif step.kind == "window":
                if window is not None:
                    raise PlanError("there is one window at most")
                if reducer is not None:
                    raise PlanError("the window comes before the reducer")
                if gate is not None:
                    raise PlanError("a gate takes no window")
                window = step.extra
            elif step.kind in ("reduce", "aggregate"):
                if reducer is not None:
                    raise PlanError("there is one reducer at most")
                if gate is not None:
                    raise PlanError("a gate takes no reducer")
                if window is None:
                    raise PlanError("a reducer needs a window")
                reducer = step
            elif step.kind == "gate":
                if gate is not None:
                    raise PlanError("there is one gate at most")
                if window is not None or reducer is not None:
                    raise PlanError("a gate takes no window and no reducer")
                gate = step
            elif step.kind in ("sink", "foreach"):
                sink = step
            elif step.kind in ("map", "filter", "flatMap"):
                (pre if reducer is None and gate is None else post).append(step)
            else:
                raise PlanError(f"unknown step {step.kind}")
        if window is not None and window.kind == "session" and reducer is None:
            raise PlanError("a session window needs a reducer")
        return Compiled(tuple(pre), key_by, window, reducer, gate, tuple(post), sink, self.config_hash())

    def config_hash(self) -> str:
        return config_hash([{"kind": s.kind, **s.config} for s in self.steps])

    def rows(self, messages: DataFrame) -> DataFrame:
        """The stage before the window: msg, partition, key, ts, id, value."""
        plan = self.compile()
        out = messages.select(F.struct(*messages.columns).alias("msg"), F.col("payload").alias("value"), "partition", F.col("id"), F.col("created_at"))
        for step in plan.pre:
            out = _apply(out, step, F.col("msg"))
        key = plan.key_by.fn(F.col("msg")).cast("string") if plan.key_by else F.col("partition")
        ts = plan.window.event_time(F.col("msg")) if plan.window is not None and plan.window.event_time is not None else F.col("created_at")
        return out.select("msg", "partition", key.alias("key"), ts.alias("ts"), "id", "value")

    def windowed(self, messages: DataFrame) -> DataFrame:
        """rows() with window bounds; a message without event time has no window and is left out (see errors())."""
        plan = self.compile()
        return windows.assign(self.rows(messages).filter(F.col("ts").isNotNull()), plan.window)

    def errors(self, messages: DataFrame) -> DataFrame:
        """Rows whose event time can't be read."""
        return self.rows(messages).filter(F.col("ts").isNull())

    def apply(self, messages: DataFrame, closed_only: bool = False) -> DataFrame:
        """The emits of a bounded log as one plan. closed_only leaves out windows that the partition's clock hasn't closed."""
        plan = self.compile()
        if plan.gate is not None:
            out = plan.gate.fn.apply(self.rows(messages))
        elif plan.window is None:
            out = self.rows(messages)
        else:
            out = self.windowed(messages)
            if plan.reducer is not None:
                keys = ["partition", "key", "window_start", "window_end"]
                clock = windows.clocks(out, plan.window) if closed_only else None
                if plan.reducer.kind == "aggregate":
                    named = aggregates.aggregate(out, plan.reducer.extra, keys)
                    out = named.select(*keys, F.struct(*[c for c in named.columns if c not in keys]).alias("value"))
                else:
                    out = aggregates.fold(out, plan.reducer.extra, plan.reducer.fn, keys)
                out = windows.closed(out, clock, plan.window) if closed_only else out
        for step in plan.post:
            out = _apply(out, step, F.col("value"))
        return out


def _apply(rows: DataFrame, step: Step, reads: Column) -> DataFrame:
    if step.kind == "map":
        return rows.withColumn("value", step.fn(reads))
    if step.kind == "filter":
        return rows.filter(step.fn(reads))
    return rows.withColumn("value", F.explode(step.fn(reads)))


def context(rows: DataFrame) -> Column:
    """What a sink or callback gets beside the value."""
    cols = {"partition": F.col("partition"), "key": F.col("key")}
    if "window_start" in rows.columns:
        cols |= {"windowKey": iso_millis(F.col("window_start")), "windowStart": F.col("window_start"), "windowEnd": F.col("window_end")}
    return F.struct(*[c.alias(k) for k, c in cols.items()])


def emits(rows: DataFrame, sink: Step, *more: Column) -> DataFrame:
    """What the sink pushes: queue, partition, payload (a value that isn't a struct becomes {value}), in one row each, and more columns if wanted."""
    value = F.col("value")
    wrapped = value if rows.schema["value"].dataType.typeName() in ("struct", "map") else F.struct(value.alias("value"))
    if sink.fn is not None:
        partition = sink.fn(value).cast("string")
    elif sink.extra is not None:
        partition = F.lit(sink.extra)
    else:
        partition = F.coalesce("partition", F.lit("Default"))
    return rows.select(F.lit(sink.config["queue"]).alias("queue"), partition.alias("partition"), F.to_json(wrapped).alias("payload"), *more)

