"""Allow/deny gates: per partition, in order, with state for each key; the first denial holds back the rest.

The rate limiters are state functions: (state, cost, now) -> (state, allowed). A batch is decided by
applyInPandas on each partition, since a decision needs the state that all before it left; streams use the
same functions in sluice.streaming.stateful.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


def _cost(value) -> float:
    """A cost that isn't a finite number from 0 on counts as one."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        return 1.0
    return x if math.isfinite(x) and x >= 0 else 1.0


def token_bucket(capacity: float, refill_per_sec: float, allow_zero_cost: bool = True) -> Callable:
    if capacity <= 0 or refill_per_sec <= 0:
        raise ValueError("capacity and refill are above 0")

    def decide(state: dict | None, cost, now: float):
        cost = _cost(cost)
        state = state or {"tokens": float(capacity), "at": now}
        tokens = min(float(capacity), state["tokens"] + max(0.0, now - state["at"]) * refill_per_sec)
        if cost == 0:
            return {"tokens": tokens, "at": now}, allow_zero_cost
        ok = tokens >= cost
        return {"tokens": tokens - cost if ok else tokens, "at": now}, ok

    return decide


def sliding_window(limit: float, window_sec: float) -> Callable:
    """Two buckets: the one before counts for the share of the window that it still covers."""
    if limit <= 0 or window_sec <= 0:
        raise ValueError("limit and window are above 0")

    def decide(state: dict | None, cost, now: float):
        cost, bucket = _cost(cost), math.floor(now / window_sec)
        state = state or {"bucket": bucket, "now": 0.0, "before": 0.0}
        if bucket > state["bucket"]:
            state = {"bucket": bucket, "now": 0.0, "before": state["now"] if bucket == state["bucket"] + 1 else 0.0}
        else:
            state = dict(state)
        used = state["before"] * (1 - (now / window_sec - bucket)) + state["now"]
        ok = used + cost <= limit
        if ok:
            state["now"] += cost
        return state, ok

    return decide


@dataclass(frozen=True)
class Gate:
    """decide as above; cost reads the value; halt: the first denial of a partition holds back all after it, whatever their key."""

    decide: Callable
    cost: Callable = lambda value: 1
    halt: bool = True

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows that are allowed, the clock being each row's ts. Rows of a partition are decided by one task."""
        decide, cost, halt = self.decide, self.cost, self.halt

        def run(pdf):
            states, keep = {}, []
            for key, ts, value in zip(pdf["key"], pdf["ts"], pdf["value"]):
                after, ok = decide(states.get(key), cost(value), ts / 1e6)
                keep.append(ok)
                if ok or not halt:
                    states[key] = after
                if not ok and halt:
                    break
            return pdf[keep + [False] * (len(pdf) - len(keep))]

        flat = rows.drop("msg")
        return flat.groupBy("partition").applyInPandas(lambda pdf: run(pdf.sort_values(["ts", "id"]).reset_index(drop=True)), flat.schema)
