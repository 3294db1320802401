"""Exact window and gate rules on streams, by stateful processors keyed by partition.

Spark's watermark is one for the query; here each partition has its own. It advances with each batch to the
newest event time less the lateness, a row is late if it is older than the watermark as the batch found it,
and all rows are folded before any window closes. A gate keeps rows behind a denied one in a backlog, in
order, and tries again as time goes by.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sluice.operators.windows import SECOND, Window
from sluice.plans.stream import Stream

_NUMBER = (int, float)


def _number(x):
    return x if isinstance(x, _NUMBER) and not isinstance(x, bool) else None


def starts(window: Window, ts: int) -> list[int]:
    """Starts of the windows that hold ts."""
    step = (window.slide or window.size) * SECOND
    first = ts - (ts - window.offset * SECOND) % step
    return [first - i * step for i in range(window.size // window.slide if window.kind == "sliding" else 1)]


class Folds:
    """The reducer's rules on one partition, over plain values: what a processor and its tests share.

    state: {"watermark": int | None, "open": {key of window: [start, end, user key, accumulator]}}.
    """

    def __init__(self, window: Window, step: Callable, initial):
        self.window, self.step, self.initial = window, step, initial

    def batch(self, state: dict, rows: list[tuple]) -> tuple[dict, list[tuple], int]:
        """rows (ts, id, key, value) of one batch -> new state, closed windows (start, end, key, accumulator), late rows."""
        w, event_time = self.window, self.window.event_time is not None
        before, late, out, open_ = state.get("watermark"), 0, [], state.setdefault("open", {})
        seen = []
        for ts, _, key, value in sorted(rows, key=lambda r: (r[0], r[1])):
            if event_time and before is not None and ts < before:
                late += 1
                if w.on_late == "drop":
                    continue
            seen.append(ts)
            if w.kind == "session":
                self._session(open_, out, key, ts, value)
                continue
            for start in starts(w, ts):
                entry = open_.setdefault(f"{start}\x1f{key}", [start, start + w.size * SECOND, key, copy.deepcopy(self.initial)])
                entry[3] = self.step(entry[3], value)
        newest = max(seen, default=None)
        if event_time:
            marks = [x for x in (before, newest - int(w.lateness * SECOND) if newest is not None else None) if x is not None]
            state["watermark"] = clock = max(marks, default=None)
        else:
            clock = newest
        out += self.close(state, clock)
        return state, out, late

    def _session(self, open_, out, key, ts, value):
        """A row joins its key's session while it is at most the gap after its last row; else the session closes, grace or not."""
        gap, entry = self.window.size * SECOND, open_.get(f"\x1f{key}")
        if entry is not None and ts > entry[1]:
            out.append(tuple(entry))
            entry = None
        if entry is None:
            entry = open_[f"\x1f{key}"] = [ts, ts + gap, key, copy.deepcopy(self.initial)]
        entry[1] = max(entry[1], ts + gap)
        entry[3] = self.step(entry[3], value)

    def close(self, state: dict, clock: int | None) -> list[tuple]:
        """Windows whose end plus grace the clock has reached; also what an idle flush calls."""
        if clock is None:
            return []
        ripe = [k for k, e in state["open"].items() if e[1] + int(self.window.grace * SECOND) <= clock]
        return [tuple(state["open"].pop(k)) for k in sorted(ripe, key=lambda k: (state["open"][k][0], k))]


class Backlog:
    """The gate's rules on one partition: rows are decided in order and the first denial holds back all after it."""

    def __init__(self, decide: Callable, cost: Callable):
        self.decide, self.cost = decide, cost

    def batch(self, state: dict, rows: list[tuple], now: float) -> tuple[dict, list[tuple]]:
        """rows (ts, id, key, value), behind those already waiting -> new state and the rows let through."""
        waiting = state.setdefault("waiting", [])
        waiting += [list(r) for r in sorted(rows, key=lambda r: (r[0], r[1]))]
        keys, passed = state.setdefault("keys", {}), 0
        for _, _, key, value in waiting:
            after, ok = self.decide(keys.get(key), self.cost(value), now)
            if not ok:
                break
            keys[key] = after  # only what an allowance leaves is kept
            passed += 1
        out, state["waiting"] = [tuple(r) for r in waiting[:passed]], waiting[passed:]
        return state, out


def _records(frames: Iterator[pd.DataFrame]) -> list[tuple]:
    return [(int(t), int(i), k, json.loads(v).get("v")) for f in frames for t, i, k, v in zip(f["ts"], f["id"], f["key"], f["value"])]


class _Processor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "json string")

    def load(self) -> dict:
        return json.loads(self.held.get()[0]) if self.held.exists() else {}

    def save(self, state: dict) -> None:
        self.held.update((json.dumps(state),))

    def close(self) -> None:
        pass


class WindowProcessor(_Processor):
    """timers: a partition with open windows is looked at again after the window's idle time."""

    def __init__(self, folds: Folds, timers: bool):
        self.folds, self.timers = folds, timers

    def idle(self, state, timerValues) -> None:
        if self.timers and state.get("open"):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.folds.window.idle_flush_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, out, _ = self.folds.batch(self.load(), _records(rows))
        self.save(state)
        self.idle(state, timerValues)
        yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.load()
        clock = state.get("watermark") if self.folds.window.event_time is not None else timerValues.getCurrentProcessingTimeInMs() * 1000
        out = self.folds.close(state, clock) if "open" in state else []
        self.save(state)
        self.idle(state, timerValues)
        yield self.frame(key, out)

    def frame(self, key, out) -> pd.DataFrame:
        return pd.DataFrame({"partition": [key[0]] * len(out), "key": [e[2] for e in out], "window_start": [e[0] for e in out], "window_end": [e[1] for e in out], "value": [json.dumps(e[3]) for e in out]}).astype({"window_start": "int64", "window_end": "int64", "partition": object, "key": object, "value": object})


class GateProcessor(_Processor):
    """timers: waiting rows are tried again after a while; else with the partition's next rows."""

    def __init__(self, backlog: Backlog, timers: bool, retry_ms: int = 100):
        self.backlog, self.timers, self.retry_ms = backlog, timers, retry_ms

    def _go(self, key, rows, timerValues):
        import time

        now = timerValues.getCurrentProcessingTimeInMs() if self.timers else int(time.time() * 1000)
        state, out = self.backlog.batch(self.load(), rows, now / 1000)
        if self.timers and state["waiting"]:
            self.handle.registerTimer(now + self.retry_ms)
        self.save(state)
        yield pd.DataFrame({"partition": [key[0]] * len(out), "key": [r[2] for r in out], "ts": [r[0] for r in out], "id": [r[1] for r in out], "value": [json.dumps(r[3]) for r in out]}).astype({"ts": "int64", "id": "int64", "partition": object, "key": object, "value": object})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._go(key, _records(rows), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go(key, [], timerValues)


def aggregate_step(spec: dict) -> tuple[Callable, dict]:
    """The named aggregates as a step over plain values; extractors get a value and return a number or anything else."""

    def step(acc, value):
        for name, extract in spec.items():
            x = _number(extract(value)) if extract is not None else None
            if name == "count":
                acc["count"] += 1 if x is None else x
            elif name in ("min", "max"):
                if x is not None:
                    acc[name] = x if acc[name] is None else (min, max)[name == "max"](acc[name], x)
            elif name == "avg":
                acc["__avg_sum"] += x or 0
                acc["__avg_count"] += x is not None
                acc["avg"] = acc["__avg_sum"] / acc["__avg_count"] if acc["__avg_count"] else None
            else:
                acc[name] += x or 0
        return acc

    initial: dict = {n: None if n in ("min", "max", "avg") else 0 for n in spec}
    return step, initial | ({"__avg_sum": 0, "__avg_count": 0} if "avg" in spec else {})


def _rows(stream: Stream, messages: DataFrame) -> DataFrame:
    """The processors' input: values travel as JSON. Rows without event time are left out."""
    rows = stream.rows(messages).filter(F.col("ts").isNotNull())
    return rows.select("partition", "key", "ts", "id", F.to_json(F.struct(F.col("value").alias("v"))).alias("value"))


def windows(stream: Stream, messages: DataFrame, timers: bool = False) -> DataFrame:
    """Closed windows with the reducer's value as JSON. Steps and extractors are Python over plain values.

    timers flushes idle partitions, for queries that keep running; a query that reads what there is and stops
    must do without, or it would run empty batches for ever.
    """
    plan = stream.compile()
    if plan.reducer.kind == "aggregate":
        step, initial = aggregate_step(plan.reducer.extra)
    else:
        step, initial = plan.reducer.fn, plan.reducer.extra
    processor = WindowProcessor(Folds(plan.window, step, initial), timers)
    return _rows(stream, messages).groupBy("partition").transformWithStateInPandas(
        processor, "partition string, key string, window_start long, window_end long, value string", "Append", "ProcessingTime" if timers else "None"
    )


def gated(stream: Stream, messages: DataFrame, timers: bool = False) -> DataFrame:
    """Rows that the gate lets through, in order, the value as JSON."""
    gate = stream.compile().gate.fn
    processor = GateProcessor(Backlog(gate.decide, gate.cost), timers)
    return _rows(stream, messages).groupBy("partition").transformWithStateInPandas(processor, "partition string, key string, ts long, id long, value string", "Append", "ProcessingTime" if timers else "None")
