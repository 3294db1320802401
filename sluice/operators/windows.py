"""Event windows over microsecond times: assignment, closing and lateness as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SECOND = 1_000_000
#: Sizes in seconds and offsets from the epoch; weeks begin on Monday, four days after it.
CALENDAR = {"second": (1, 0), "minute": (60, 0), "hour": (3600, 0), "day": (86400, 0), "week": (604800, 345600)}


@dataclass(frozen=True)
class Window:
    """kind is tumbling, sliding, session or cron; seconds throughout."""

    kind: str
    size: int
    slide: int = 0
    offset: int = 0
    grace: float = 0
    lateness: float = 0
    on_late: str = "drop"
    idle_flush_ms: int = 5000
    event_time: object = None

    def __post_init__(self):
        if self.size <= 0 or self.grace < 0 or self.lateness < 0:
            raise ValueError("a window's size is above 0, its grace and lateness 0 or more")
        if self.kind == "sliding" and (self.slide <= 0 or self.size % self.slide):
            raise ValueError("a sliding window's size is a multiple of its slide")
        if self.on_late not in ("drop", "include"):
            raise ValueError("on_late is drop or include")

    def config(self) -> dict:
        out = {"kind": f"window:{self.kind}", "size": self.size, "grace": self.grace, "lateness": self.lateness, "onLate": self.on_late, "eventTime": self.event_time is not None}
        return out | ({"slide": self.slide} if self.kind == "sliding" else {}) | ({"offset": self.offset} if self.kind == "cron" else {})


def floor_to(ts: Column, size: int, offset: int = 0) -> Column:
    """The start of the epoch-aligned interval that holds ts."""
    return ts - F.pmod(ts - offset * SECOND, F.lit(size * SECOND))


def assign(rows: DataFrame, window: Window, ts: str = "ts", keys: tuple[str, ...] = ("partition", "key")) -> DataFrame:
    """Adds window_start and window_end; a sliding window copies a row for each of its windows, a session covers rows at most `size` apart (inclusive)."""
    at = F.col(ts)
    if window.kind == "sliding":
        last = floor_to(at, window.slide)
        starts = F.transform(F.sequence(F.lit(0), F.lit(window.size // window.slide - 1)), lambda i: last - i * (window.slide * SECOND))
        return rows.withColumn("window_start", F.explode(starts)).withColumn("window_end", F.col("window_start") + window.size * SECOND)
    if window.kind == "session":
        order = W.partitionBy(*keys).orderBy(ts, "id")
        opens = F.coalesce(at - F.lag(ts).over(order) > window.size * SECOND, F.lit(True))
        numbered = rows.withColumn("_session", F.sum(opens.cast("long")).over(order))
        whole = W.partitionBy(*keys, "_session")
        return numbered.withColumn("window_start", F.min(ts).over(whole)).withColumn("window_end", F.max(ts).over(whole) + window.size * SECOND).drop("_session")
    start = floor_to(at, window.size, window.offset)
    return rows.withColumn("window_start", start).withColumn("window_end", start + window.size * SECOND)


def closed(windows: DataFrame, clocks: DataFrame, window: Window, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """Windows whose end plus grace the partition's clock has reached; clocks has the keys and `clock`."""
    met = windows.join(clocks, list(keys))
    return met.filter(F.col("window_end") + int(window.grace * SECOND) <= F.col("clock")).drop("clock")


def clocks(rows: DataFrame, window: Window, ts: str = "ts", keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """Per partition the watermark (event time) or newest time (processing time) of these rows."""
    late = int(window.lateness * SECOND) if window.event_time is not None else 0
    return rows.groupBy(*keys).agg((F.max(ts) - late).alias("clock"))


def late(rows: DataFrame, before: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """Adds `is_late`: older than the partition's watermark as it stood before these rows (clocks of the earlier batch)."""
    known = before.withColumnRenamed("clock", "_before")
    return rows.join(known, list(keys), "left").withColumn("is_late", F.coalesce(F.col(ts) < F.col("_before"), F.lit(False))).drop("_before")
