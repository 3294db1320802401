"""Every operator as a query over the driver's tables, with the same result in DuckDB's SQL.

The log is `events`: a queue for each event type, a partition for each user. Two groups read it up to fixed
dates: `alpha` all lanes up to FIRST, `beta` the lanes of even users up to SECOND_CUT; __QUEUE_MODE__ up to
SECOND_CUT. Errors are dead letters of alpha. Times are microseconds.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import scalars
from sluice.operators import analytics as a
from sluice.operators import gates, windows
from sluice.operators import queue as q
from sluice.plans.stream import Stream, context, emits
from sluice.sources.messages import from_events

DAY = 86400 * q.SECOND


def at(year: int, month: int, day: int) -> int:
    return int(datetime(year, month, day, tzinfo=timezone.utc).timestamp()) * q.SECOND


FIRST, SECOND_CUT, NOW = at(2024, 1, 10), at(2024, 1, 20), at(2024, 2, 1)

EV = """ev AS (SELECT event_id AS id, event_id::VARCHAR AS transaction_id, event_type AS queue, user_id::VARCHAR AS partition, epoch_us(ts) AS created_at,
  user_id, event_type, value::DECIMAL(18,2) AS value, regexp_extract(props, '"k": *([0-9]+)', 1)::INT AS k FROM events)"""
CUR = f"""cur AS (
  SELECT queue, partition, 'alpha' AS consumer_group, max(row(created_at, id)) FILTER (WHERE created_at <= {FIRST}) AS last FROM ev GROUP BY queue, partition
  UNION ALL SELECT queue, partition, 'beta', max(row(created_at, id)) FILTER (WHERE created_at <= {SECOND_CUT}) FROM ev WHERE user_id % 2 = 0 GROUP BY queue, partition
  UNION ALL SELECT queue, partition, '{q.QUEUE_MODE}', max(row(created_at, id)) FILTER (WHERE created_at <= {SECOND_CUT}) FROM ev GROUP BY queue, partition)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Registers a function under its name, with its SQL after some common table expressions."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return fn

    return add


def cursors(m: DataFrame) -> DataFrame:
    """The groups' cursors, with leases: beta's lanes are held until after NOW, with batches of five of which two are acknowledged."""

    def one(group: str, rows: DataFrame, upto: int) -> DataFrame:
        c = q.seek(rows, None, group, ts=upto)
        held = group == "beta"
        return c.select("*", F.lit(NOW + DAY if held else None).cast("long").alias("lease_until"), F.lit("w1" if held else None).cast("string").alias("worker"), F.lit(5).alias("batch_size"), F.lit(2).alias("acked"), F.lit(0).alias("retries"))

    even = m.filter(F.col("partition").cast("long") % 2 == 0)
    return one("alpha", m, FIRST).union(one("beta", even, SECOND_CUT)).union(one(q.QUEUE_MODE, m, SECOND_CUT))


def dead(m: DataFrame) -> DataFrame:
    return m.filter("queue = 'error'").select("id", *q.LANE, F.lit("alpha").alias("consumer_group"), F.lit("boom").alias("error"), F.lit(3).alias("retry_count"), (F.col("created_at") + 1).alias("failed_at"))


def lanes_only(m: DataFrame) -> DataFrame:
    return m.select("id", "transaction_id", *q.LANE, "created_at")


def value_of(m):
    return m["payload"]["value"]


def flat(rows: DataFrame, *fields: str) -> DataFrame:
    return rows.select(F.col("partition"), F.col("key"), "window_start", "window_end", *[F.col(f"value.{f}").cast("double").alias(f.strip("_")) if f != "count" else F.col("value.count").cast("long").alias("count") for f in fields])


# --- pipeline operators -----------------------------------------------------------------------------

_NUMBERS = {"count": None, "sum": lambda v: v["value"], "min": lambda v: v["value"], "max": lambda v: v["value"], "avg": lambda v: v["value"]}
_SUMS = "count(*) AS count, sum(value)::DOUBLE AS sum, min(value)::DOUBLE AS min, max(value)::DOUBLE AS max"


@query(f"SELECT partition, partition AS key, created_at // {DAY} * {DAY} AS window_start, created_at // {DAY} * {DAY} + {DAY} AS window_end, {_SUMS} FROM ev GROUP BY partition, created_at // {DAY}", EV)
def tumbling_agg(spark, d):
    plan = Stream.from_("events").key_by(lambda m: m["partition"]).window_tumbling(86400).aggregate({k: _NUMBERS[k] for k in ("count", "sum", "min", "max")})
    return flat(plan.apply(from_events(spark, d)), "count", "sum", "min", "max")


@query("SELECT id, (value * 2)::DOUBLE AS doubled, upper(event_type) AS kind FROM ev", EV)
def map_project(spark, d):
    plan = Stream.from_("events").map(lambda m: F.struct((value_of(m) * 2).alias("doubled"), F.upper(m["queue"]).alias("kind")))
    return plan.apply(from_events(spark, d)).select("id", F.col("value.doubled").cast("double").alias("doubled"), "value.kind")


@query("SELECT id, partition FROM ev WHERE value > 50 AND event_type <> 'error'", EV)
def filter_pred(spark, d):
    plan = Stream.from_("events").filter(lambda m: (value_of(m) > 50) & (m["queue"] != "error"))
    return plan.apply(from_events(spark, d)).select("id", "partition")


@query("SELECT id, unnest(string_split(event_type, 'r')) AS part FROM ev", EV)
def flatmap_explode(spark, d):
    return Stream.from_("events").flat_map(lambda m: F.split(m["queue"], "r")).apply(from_events(spark, d)).select("id", F.col("value").alias("part"))


@query("SELECT id, (k % 7)::VARCHAR AS key FROM ev", EV)
def key_by(spark, d):
    return Stream.from_("events").key_by(lambda m: m["payload"]["k"] % 7).map(lambda m: m["id"]).apply(from_events(spark, d)).select("id", "key")


@query("SELECT id, value::DOUBLE AS value FROM ev WHERE value > 10", EV)
def pre_maps_read_the_message(spark, d):
    plan = Stream.from_("events").map(lambda m: value_of(m) * 100).filter(lambda m: value_of(m) > 10).map(value_of)
    return plan.apply(from_events(spark, d)).select("id", F.col("value").cast("double"))


@query(f"SELECT partition, s AS window_start, s + {3 * DAY} AS window_end, count(*) AS count, sum(value)::DOUBLE AS sum FROM (SELECT *, (created_at // {DAY} - i) * {DAY} AS s FROM ev, range(3) r(i)) GROUP BY partition, s", EV)
def sliding_agg(spark, d):
    plan = Stream.from_("events").window_sliding(3 * 86400, 86400).aggregate({k: _NUMBERS[k] for k in ("count", "sum")})
    return flat(plan.apply(from_events(spark, d)), "count", "sum").drop("key")


@query(
    f"""SELECT partition, min(created_at) AS window_start, max(created_at) + {1800 * q.SECOND} AS window_end, count(*) AS count, sum(value)::DOUBLE AS sum
  FROM (SELECT *, sum(o) OVER (PARTITION BY partition ORDER BY created_at, id) AS s FROM (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY partition ORDER BY created_at, id) <= {1800 * q.SECOND} THEN 0 ELSE 1 END AS o FROM ev)) GROUP BY partition, s""",
    EV,
)
def session_agg(spark, d):
    plan = Stream.from_("events").window_session(1800).aggregate({k: _NUMBERS[k] for k in ("count", "sum")})
    return flat(plan.apply(from_events(spark, d)), "count", "sum").drop("key")


def _cron(every: str):
    size, offset = windows.CALENDAR[every]
    step, base = size * q.SECOND, offset * q.SECOND

    def run(spark, d):
        plan = Stream.from_("events").key_by(lambda m: m["queue"]).window_cron(every).aggregate({"count": None})
        return plan.apply(from_events(spark, d)).select("partition", "key", "window_start", F.col("value.count").alias("count"))

    run.__name__ = f"cron_{every}"
    query(f"SELECT partition, event_type AS key, (created_at - {base}) // {step} * {step} + {base} AS window_start, count(*) AS count FROM ev GROUP BY ALL", EV)(run)


for _every in windows.CALENDAR:
    _cron(_every)


@query(f"SELECT partition, created_at // {DAY} * {DAY} AS window_start, string_agg(event_type, '>' ORDER BY created_at, id) AS path FROM ev GROUP BY partition, created_at // {DAY}", EV)
def reduce_fold(spark, d):
    plan = Stream.from_("events").map(lambda m: m["queue"]).window_tumbling(86400).reduce(lambda acc, v: F.when(acc == "", v).otherwise(F.concat(acc, F.lit(">"), v)), F.lit(""))
    return plan.apply(from_events(spark, d)).select("partition", "window_start", F.col("value").alias("path"))


@query(f"SELECT partition, created_at // {DAY} * {DAY} AS window_start, arg_max(event_type, row(created_at, id)) AS last FROM ev GROUP BY partition, created_at // {DAY}", EV)
def reduce_last(spark, d):
    plan = Stream.from_("events").map(lambda m: m["queue"]).window_tumbling(86400).reduce(lambda acc, v: v, F.lit(None).cast("string"))
    return plan.apply(from_events(spark, d)).select("partition", "window_start", F.col("value").alias("last"))


@query(f"SELECT partition, created_at // {DAY} * {DAY} AS window_start, sum(value)::DOUBLE / count(*) AS avg, sum(value)::DOUBLE AS avg_sum, count(*) AS avg_count, sum(k)::BIGINT AS ks FROM ev GROUP BY partition, created_at // {DAY}", EV)
def aggregate_avg(spark, d):
    plan = Stream.from_("events").window_tumbling(86400).aggregate({"avg": lambda v: v["value"].cast("double"), "ks": lambda v: v["k"]})
    out = plan.apply(from_events(spark, d)).select("partition", "window_start", "value.*")
    total = F.round("__avg_sum", 2)
    return out.select("partition", "window_start", (total / F.col("__avg_count")).alias("avg"), total.alias("avg_sum"), F.col("__avg_count").alias("avg_count"), F.col("ks").cast("long"))


@query(
    f"""SELECT w.partition, window_start, n FROM (SELECT partition, created_at // {DAY} * {DAY} AS window_start, count(*) AS n FROM ev GROUP BY partition, created_at // {DAY}) w
  JOIN (SELECT partition, max(created_at) AS c FROM ev GROUP BY partition) p ON w.partition = p.partition WHERE window_start + {DAY} + {DAY // 2} <= c""",
    EV,
)
def closed_windows_only(spark, d):
    plan = Stream.from_("events").window_tumbling(86400, grace_period=43200).aggregate({"count": None})
    return plan.apply(from_events(spark, d), closed_only=True).select("partition", "window_start", F.col("value.count").alias("n"))


@query(
    f"""SELECT e.id, e.partition FROM ev e JOIN (SELECT partition, max(created_at) - {DAY} AS w FROM ev WHERE created_at < {SECOND_CUT} GROUP BY partition) b ON e.partition = b.partition
  WHERE e.created_at >= {FIRST} AND e.created_at < w""",
    EV,
)
def late_rows(spark, d):
    m = from_events(spark, d).withColumnRenamed("created_at", "ts")
    window = windows.Window("tumbling", 86400, lateness=86400, event_time=True)
    before = windows.clocks(m.filter(F.col("ts") < SECOND_CUT), window)
    return windows.late(m.filter(F.col("ts") >= FIRST), before).filter("is_late").select("id", "partition")


@query(f"SELECT partition, created_at // {DAY} * {DAY} AS window_start, count(*) AS n, CASE WHEN count(*) > 4 THEN 'high' ELSE 'low' END AS level FROM ev GROUP BY partition, created_at // {DAY} HAVING count(*) > 2", EV)
def threshold_alert(spark, d):
    plan = Stream.from_("events").window_tumbling(86400).aggregate({"count": None}).filter(lambda v: v["count"] > 2).map(lambda v: F.struct(v["count"].alias("n"), F.when(v["count"] > 4, "high").otherwise("low").alias("level")))
    return plan.apply(from_events(spark, d)).select("partition", "window_start", "value.n", "value.level")


@query(f"SELECT DISTINCT partition, created_at // {DAY} * {DAY} AS window_start, event_type FROM ev", EV)
def in_window_dedup(spark, d):
    out = Stream.from_("events").map(lambda m: m["queue"]).window_tumbling(86400).windowed(from_events(spark, d))
    return out.select("partition", "window_start", F.col("value").alias("event_type")).distinct()


@query(f"SELECT 'daily' AS queue, event_type AS partition, '{{\"count\":' || count(*) || '}}' AS payload, strftime(make_timestamp(created_at // {DAY} * {DAY}), '%Y-%m-%dT00:00:00.000Z') AS window_key FROM ev GROUP BY user_id, event_type, created_at // {DAY}", EV)
def sink_emits(spark, d):
    plan = Stream.from_("events").key_by(lambda m: m["queue"]).window_tumbling(86400).aggregate({"count": None}).to("daily", lambda v: F.col("key"))
    rows = plan.apply(from_events(spark, d))
    return emits(rows, plan.compile().sink, context(rows)["windowKey"].alias("window_key"))


@query()
def token_bucket(spark, d):
    """Rows a bucket of three tokens lets pass, one token a day; rows-only, see the tests for its invariants."""
    gate = gates.Gate(gates.token_bucket(3, 1 / 86400), halt=False)
    return Stream.from_("events").map(lambda m: m["payload"]["k"]).gate(gate).apply(from_events(spark, d)).select("id", "partition", "ts")


@query()
def sliding_window_gate(spark, d):
    gate = gates.Gate(gates.sliding_window(4, 86400), cost=lambda v: 1 + v % 2, halt=False)
    return Stream.from_("events").map(lambda m: m["payload"]["k"]).gate(gate).apply(from_events(spark, d)).select("id", "partition", "ts")


# --- log operators ----------------------------------------------------------------------------------


def _items(m: DataFrame) -> DataFrame:
    """A batch: every message again, and twice a new one for each."""
    again = lanes_only(m).select((F.col("id") * 4).alias("idx"), (F.col("id") + 10**9).alias("id"), "transaction_id", *q.LANE, "created_at")
    new = again.select((F.col("idx") + 1).alias("idx"), "id", F.concat(F.lit("n"), "transaction_id").alias("transaction_id"), *q.LANE, "created_at")
    return again.union(new).union(new.select((F.col("idx") + 1).alias("idx"), (F.col("id") + 10**9).alias("id"), "transaction_id", *q.LANE, "created_at"))


@query("SELECT id * 4 + o AS idx, CASE WHEN o = 1 THEN 'queued' ELSE 'duplicate' END AS status, CASE WHEN o = 0 THEN id ELSE id + 1000000000 END AS message_id FROM ev, range(3) r(o)", EV)
def push_status(spark, d):
    m = from_events(spark, d)
    return q.push(lanes_only(m), _items(m)).select("idx", "status", "message_id")


@query("SELECT id + 1000000000 AS id, 'n' || transaction_id AS transaction_id, queue, partition, created_at FROM ev", EV)
def push_dedup(spark, d):
    m = from_events(spark, d)
    return q.appended(q.push(lanes_only(m), _items(m)))


_UNREAD = "u AS (SELECT ev.* FROM ev JOIN cur ON ev.queue = cur.queue AND ev.partition = cur.partition AND consumer_group = 'alpha' WHERE last IS NULL OR row(created_at, id) > last)"


@query("SELECT id, queue, partition, rn FROM (SELECT *, row_number() OVER (PARTITION BY queue, partition ORDER BY created_at, id) AS rn FROM u) WHERE rn <= 3", EV, CUR, _UNREAD)
def pop_batch(spark, d):
    m = from_events(spark, d)
    return q.pop(lanes_only(m), cursors(m), "alpha", 3, NOW).select("id", *q.LANE, F.col("rn").cast("long"))


@query(
    """SELECT id, queue, partition, rn FROM (SELECT u.*, row_number() OVER (PARTITION BY u.queue, u.partition ORDER BY created_at, id) AS rn, b FROM u JOIN
  (SELECT queue, partition, coalesce(sum(least(n, 25)) OVER (ORDER BY pos NULLS FIRST, queue, partition ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM
    (SELECT u.queue, u.partition, count(*) AS n, any_value(c.last[1]) AS pos FROM u JOIN cur c ON u.queue = c.queue AND u.partition = c.partition AND c.consumer_group = 'alpha' GROUP BY u.queue, u.partition ORDER BY pos NULLS FIRST, queue, partition LIMIT 10)) l
  ON u.queue = l.queue AND u.partition = l.partition) WHERE b + rn <= 25""",
    EV, CUR, _UNREAD,
)
def pop_global_cap(spark, d):
    m = from_events(spark, d)
    return q.pop_global(lanes_only(m), cursors(m), "alpha", 25, 10, NOW).select("id", *q.LANE, F.col("rn").cast("long"))


@query(f"SELECT id, queue, partition FROM u WHERE created_at <= {SECOND_CUT - DAY}", EV, CUR, _UNREAD)
def pop_delayed(spark, d):
    m = from_events(spark, d)
    return q.ready(q.unread(lanes_only(m), cursors(m), "alpha"), SECOND_CUT, delayed=86400).select("id", *q.LANE)


@query(f"SELECT u.id, u.queue, u.partition FROM u JOIN (SELECT queue, partition FROM u GROUP BY ALL HAVING max(created_at) <= {NOW - 3 * DAY}) b ON u.queue = b.queue AND u.partition = b.partition", EV, CUR, _UNREAD)
def pop_window_buffer(spark, d):
    m = from_events(spark, d)
    return q.ready(q.unread(lanes_only(m), cursors(m), "alpha"), NOW, buffer=3 * 86400).select("id", *q.LANE)


@query(f"SELECT id, queue, partition FROM ev WHERE created_at > {FIRST}", EV)
def pop_subscription_start(spark, d):
    m = from_events(spark, d)
    return q.unread(lanes_only(m), cursors(m).limit(0), "gamma", start_at=F.lit(FIRST)).select("id", *q.LANE)


@query(f"SELECT queue, partition, count(*) AS batch_size, {NOW + 60 * q.SECOND} AS lease_until, 'w9' AS worker FROM (SELECT *, row_number() OVER (PARTITION BY queue, partition ORDER BY created_at, id) AS rn FROM u) WHERE rn <= 3 GROUP BY queue, partition", EV, CUR, _UNREAD)
def pop_lease(spark, d):
    m = from_events(spark, d)
    c = cursors(m)
    rows = q.lease(q.pop(lanes_only(m), c, "alpha", 3, NOW), c, "alpha", "w9", NOW)
    return rows.select(*q.LANE, F.col("batch_size").cast("long"), "lease_until", "worker")


def _acks(m: DataFrame, status) -> DataFrame:
    """An acknowledgement by beta for every message after its cut-off; of odd partitions it holds no lease."""
    rows = m.filter(F.col("created_at") > SECOND_CUT)
    return rows.select(F.col("id").alias("idx"), *q.LANE, "transaction_id", F.lit("beta").alias("consumer_group"), F.lit("w1").alias("worker"), status.alias("status"), F.when(F.col("id") % 2 == 0, "why").alias("reason"), F.lit(1).alias("retry_limit"))


def _mixed(m: DataFrame):
    """All kinds of acknowledgements, mostly good ones."""
    k = F.col("payload.k") % 8
    return F.when(k == 1, "success").when(k == 2, "failed").when(k == 3, "dlq").when(k == 4, "retry").otherwise("completed")


_ACKED = f"SELECT * FROM ev WHERE created_at > {SECOND_CUT}"
_HELD = f"""a AS (SELECT queue, partition, created_at, id, row_number() OVER (PARTITION BY queue, partition ORDER BY created_at, id) AS rn,
  CASE k % 8 WHEN 1 THEN 'success' WHEN 2 THEN 'failed' WHEN 3 THEN 'dlq' WHEN 4 THEN 'retry' ELSE 'completed' END AS st FROM ({_ACKED}) WHERE user_id % 2 = 0)"""
_DONE, _FULL = "st IN ('completed', 'success')", "(size > 0 AND acked + 1 >= size)"
_GONE = "(st = 'dlq' OR (st = 'failed' AND retries >= 1))"
_AGAIN = f"(st = 'failed' AND NOT {_GONE} AND worker IS NOT NULL)"
_MOVES = f"({_DONE} OR {_GONE})"
_FREE = f"(({_MOVES} AND {_FULL}) OR {_AGAIN} OR st = 'retry')"
#: One step for each acknowledgement of a lane, in order.
_FOLD = f"""f AS (
  SELECT queue, partition, 0::BIGINT AS rn, last[1] AS pos, last[2] AS lid, {NOW + DAY}::BIGINT AS lease_until, 'w1' AS worker, 2 AS acked, 5 AS size, 0 AS retries, NULL::BIGINT AS dead, NULL::INT AS dead_retries FROM cur WHERE consumer_group = 'beta'
  UNION ALL SELECT f.queue, f.partition, a.rn, CASE WHEN {_MOVES} THEN a.created_at ELSE pos END, CASE WHEN {_MOVES} THEN a.id ELSE lid END,
    CASE WHEN NOT {_FREE} THEN lease_until END, CASE WHEN NOT {_FREE} THEN worker END,
    CASE WHEN {_AGAIN} OR ({_MOVES} AND {_FULL}) THEN 0 WHEN {_MOVES} THEN acked + 1 ELSE acked END, CASE WHEN {_AGAIN} THEN 0 ELSE size END,
    CASE WHEN {_AGAIN} THEN retries + 1 WHEN {_DONE} AND {_FULL} THEN 0 ELSE retries END, CASE WHEN {_GONE} THEN a.id END, CASE WHEN {_GONE} THEN retries END
  FROM f JOIN a ON f.queue = a.queue AND f.partition = a.partition AND a.rn = f.rn + 1)"""


@query(
    """SELECT c.queue, c.partition, c.consumer_group, coalesce(x.pos, c.last[1]) AS last_at, coalesce(x.lid, c.last[2]) AS last_id, x.lease_until, x.worker, coalesce(x.acked, 2) AS acked, coalesce(x.size, 5) AS batch_size, coalesce(x.retries, 0) AS retries
  FROM cur c LEFT JOIN (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY queue, partition ORDER BY rn DESC) = 1) x ON c.queue = x.queue AND c.partition = x.partition AND c.consumer_group = 'beta'""",
    "RECURSIVE " + EV, CUR, _HELD, _FOLD,
)
def ack_cumulative(spark, d):
    m = from_events(spark, d)
    checked = q.validated(_acks(m, _mixed(m)), lanes_only(m), cursors(m), NOW)
    return q.ack(cursors(m), checked, NOW).select(*q.LANE, "consumer_group", "last_at", "last_id", "lease_until", "worker", "acked", "batch_size", "retries")


@query("SELECT dead AS id, queue, partition, CASE WHEN dead % 2 = 0 THEN 'why' ELSE 'Retries exhausted' END AS error, dead_retries AS retry_count FROM f WHERE dead IS NOT NULL", "RECURSIVE " + EV, CUR, _HELD, _FOLD)
def dlq_split(spark, d):
    m = from_events(spark, d)
    checked = q.validated(_acks(m, _mixed(m)), lanes_only(m), cursors(m), NOW)
    return q.dead_letters(checked, NOW).select("id", *q.LANE, "error", "retry_count")


@query(f"SELECT id AS idx, CASE WHEN id % 5 = 0 THEN 'Message not found' WHEN id % 7 = 0 OR user_id % 2 = 1 THEN 'Invalid or expired lease' END AS error FROM ({_ACKED})", EV)
def ack_errors(spark, d):
    m = from_events(spark, d)
    acks = _acks(m, F.lit("completed")).withColumn("transaction_id", F.when(F.col("idx") % 5 == 0, "nobody").otherwise(F.col("transaction_id"))).withColumn("worker", F.when(F.col("idx") % 7 == 0, "w2").otherwise(F.col("worker")))
    return q.validated(acks, lanes_only(m), cursors(m), NOW).select("idx", "error")


@query(f"SELECT queue, partition, (max(row(created_at, id)) FILTER (WHERE created_at <= {FIRST}))[1] AS last_at, (max(row(created_at, id)) FILTER (WHERE created_at <= {FIRST}))[2] AS last_id FROM ev GROUP BY queue, partition", EV)
def seek_timestamp(spark, d):
    return q.seek(from_events(spark, d), None, "gamma", ts=FIRST).drop("consumer_group")


@query("SELECT queue, partition, max(row(created_at, id))[1] AS last_at, max(row(created_at, id))[2] AS last_id FROM ev GROUP BY queue, partition", EV)
def seek_end(spark, d):
    return q.seek(from_events(spark, d), None, "gamma").drop("consumer_group")


@query("SELECT DISTINCT queue, partition FROM u", EV, CUR, _UNREAD)
def has_pending(spark, d):
    m = from_events(spark, d)
    lanes = q.start_places(q.zone_map(m), cursors(m), "alpha")
    return lanes.filter(F.col("last_at").isNull() | (F.col("newest") > q.place("last_at", "last_id"))).select(*q.LANE)


@query("SELECT queue, partition, max(row(created_at, id))[1] AS newest_at, max(row(created_at, id))[2] AS newest_id, count(*) AS n FROM ev GROUP BY queue, partition", EV)
def zone_map(spark, d):
    return q.zone_map(from_events(spark, d)).select(*q.LANE, F.col("newest.at").alias("newest_at"), F.col("newest.id").alias("newest_id"), "n")


@query(f"SELECT id FROM ev WHERE created_at < {NOW - 7 * DAY}", EV)
def retention_expired(spark, d):
    return q.expired(from_events(spark, d), NOW, 7 * 86400).select("id")


@query(f"SELECT id FROM ev JOIN (SELECT queue, partition, min(last) AS low FROM cur GROUP BY queue, partition) c ON ev.queue = c.queue AND ev.partition = c.partition WHERE row(created_at, id) <= low AND created_at < {NOW - 25 * DAY}", EV, CUR)
def retention_completed(spark, d):
    m = from_events(spark, d)
    return q.completed(lanes_only(m), cursors(m), NOW, 25 * 86400).select("id")


@query(f"SELECT id FROM ev JOIN (SELECT queue, partition, min(last) AS low, bool_or(last IS NULL) AS none FROM cur GROUP BY queue, partition) c ON ev.queue = c.queue AND ev.partition = c.partition WHERE (none OR row(created_at, id) > low) AND created_at < {NOW - 15 * DAY}", EV, CUR)
def evict_pending(spark, d):
    m = from_events(spark, d)
    return q.overdue(lanes_only(m), cursors(m), NOW, 15 * 86400).select("id")


@query(f"SELECT queue, partition FROM (SELECT queue, partition, max(created_at) AS t, bool_or(created_at >= {SECOND_CUT}) AS kept FROM ev GROUP BY queue, partition) WHERE t < {NOW - 12 * DAY} AND NOT kept", EV)
def partition_cleanup(spark, d):
    m = from_events(spark, d)
    lanes = m.groupBy(*q.LANE).agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("last_activity"), F.max("created_at").alias("last_consumed"))
    return q.dead_partitions(lanes, m.filter(F.col("created_at") >= SECOND_CUT), NOW, 12).select(*q.LANE)


# --- analytics --------------------------------------------------------------------------------------

_LAG = f"""lg AS (SELECT c.queue, c.partition, c.consumer_group, any_value(c.last) AS last, count(e.id) FILTER (WHERE c.last IS NULL OR row(e.created_at, e.id) > c.last) AS lag,
  min(e.created_at) FILTER (WHERE c.last IS NULL OR row(e.created_at, e.id) > c.last) AS oldest_at FROM cur c LEFT JOIN ev e ON c.queue = e.queue AND c.partition = e.partition GROUP BY c.queue, c.partition, c.consumer_group),
l AS (SELECT *, ({NOW} - oldest_at) // {q.SECOND} AS lag_seconds FROM lg)"""


@query("SELECT queue, partition, consumer_group, lag, oldest_at, lag_seconds FROM l", EV, CUR, _LAG)
def lag_per_partition(spark, d):
    m = from_events(spark, d)
    return a.lag(lanes_only(m), cursors(m), NOW)


@query(f"SELECT consumer_group, queue, count(*) AS members, sum(lag)::BIGINT AS total_lag, coalesce(max(lag_seconds), 0) AS max_lag_seconds, CASE WHEN count(last) = 0 THEN 'Dead' WHEN coalesce(max(lag_seconds), 0) > {a.LAGGING} THEN 'Lagging' ELSE 'Stable' END AS state FROM l GROUP BY consumer_group, queue", EV, CUR, _LAG)
def consumer_groups(spark, d):
    m = from_events(spark, d)
    return a.consumer_groups(lanes_only(m), cursors(m), NOW)


@query(
    f"""SELECT consumer_group, c.queue, count(*) AS members, count(*) FILTER (WHERE last IS NULL OR newest > last) AS partitions_with_lag,
  coalesce(max(CASE WHEN last IS NULL OR newest > last THEN ({NOW} - newest[1]) // {q.SECOND} END), 0) AS max_time_lag
  FROM cur c JOIN (SELECT queue, partition, max(row(created_at, id)) AS newest FROM ev GROUP BY queue, partition) z ON c.queue = z.queue AND c.partition = z.partition GROUP BY consumer_group, c.queue""",
    EV, CUR,
)
def consumer_groups_fast(spark, d):
    m = from_events(spark, d)
    return a.consumer_groups_fast(lanes_only(m), cursors(m), NOW).drop("total_lag")


@query("SELECT queue, partition, lag, lag_seconds FROM l WHERE consumer_group = 'beta'", EV, CUR, _LAG)
def group_details(spark, d):
    m = from_events(spark, d)
    rows = a.group_details(lanes_only(m), cursors(m), "beta", NOW)
    return rows.select("queue", F.explode("partitions").alias("p")).select("queue", "p.partition", "p.lag", "p.lag_seconds")


@query(f"SELECT queue, partition, consumer_group, lag, lag_seconds, ((lag_seconds * 100 + 1800) // 3600)::DOUBLE / 100 AS lag_hours FROM l WHERE lag_seconds > {15 * 86400}", EV, CUR, _LAG)
def lagging_partitions(spark, d):
    m = from_events(spark, d)
    return a.lagging_partitions(lanes_only(m), cursors(m), NOW, 15 * 86400).drop("oldest_at")


_STATUS = """SELECT ev.id, CASE WHEN ev.queue = 'error' THEN 'dead_letter' WHEN row(ev.created_at, ev.id) <= c.last THEN 'completed' ELSE 'pending' END AS status
  FROM ev LEFT JOIN cur c ON ev.queue = c.queue AND ev.partition = c.partition AND c.consumer_group = 'alpha'"""


@query(_STATUS, EV, CUR)
def message_status(spark, d):
    m = from_events(spark, d)
    return a.status(lanes_only(m), cursors(m), dead(m), NOW, "alpha").select("id", "status")


@query(
    f"""SELECT ev.id, 'hybrid' AS mode, CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END AS groups, count(c.last) FILTER (WHERE c.consumer_group <> '{q.QUEUE_MODE}' AND row(ev.created_at, ev.id) <= c.last) AS consumed_by
  FROM ev JOIN cur c ON ev.queue = c.queue AND ev.partition = c.partition GROUP BY ev.id, user_id ORDER BY max(ev.created_at) DESC, ev.id DESC LIMIT 500 OFFSET 20""",
    EV, CUR,
)
def list_messages(spark, d):
    """The newest 500 messages after 20: a page, which is the feature."""
    m = from_events(spark, d)
    out = a.list_messages(lanes_only(m), cursors(m), dead(m), NOW, 500, 20)
    return out.select("id", "mode", F.col("groups").cast("int"), F.col("consumed_by").cast("long"))


@query("SELECT id, transaction_id, error FROM (SELECT id, transaction_id, 'boom' AS error, created_at FROM ev WHERE queue = 'error' ORDER BY created_at DESC, id DESC LIMIT 100)", EV)
def dead_letter_page(spark, d):
    m = from_events(spark, d)
    return a.dead_letter_list(dead(m), m, 100).select("id", "transaction_id", "error")


@query(f"SELECT b AS bucket, count(id) AS n FROM (SELECT unnest(range({at(2023, 12, 31)}, {NOW + 1}, {3600 * q.SECOND})) AS b) s LEFT JOIN ev ON created_at // {3600 * q.SECOND} * {3600 * q.SECOND} = b AND queue = 'signup' GROUP BY b", EV)
def analytics_gapfill(spark, d):
    return a.messages_over_time(from_events(spark, d), at(2023, 12, 31), NOW, "hour", queue="signup")


_STATS = f"""ps AS (SELECT l.queue, l.partition, l.consumer_group, t.total, l.lag - p AS pending, p AS processing, greatest(t.total - l.lag - dead, 0) AS completed, dead, lag_seconds FROM
  (SELECT *, CASE WHEN consumer_group = 'beta' THEN least(3, lag) ELSE 0 END AS p FROM l) l JOIN (SELECT queue, partition, count(*) AS total FROM ev GROUP BY queue, partition) t ON l.queue = t.queue AND l.partition = t.partition,
  LATERAL (SELECT CASE WHEN l.queue = 'error' AND l.consumer_group = 'alpha' THEN t.total ELSE 0 END AS dead)),
qs AS (SELECT queue, count(*) AS partitions, sum(total)::BIGINT AS total, sum(pending)::BIGINT AS pending, sum(processing)::BIGINT AS processing, sum(completed)::BIGINT AS completed, sum(dead)::BIGINT AS dead, avg(lag_seconds) AS avg_lag, max(lag_seconds) AS max_lag
  FROM (SELECT queue, partition, max(total) AS total, max(pending) AS pending, max(processing) AS processing, max(completed) AS completed, max(dead) AS dead, max(lag_seconds) AS lag_seconds FROM ps GROUP BY queue, partition) GROUP BY queue)"""


def _stats(spark, d) -> DataFrame:
    m = from_events(spark, d)
    return a.partition_stats(lanes_only(m), cursors(m), dead(m), NOW)


@query("SELECT queue, partition, consumer_group, total, pending, processing, completed, dead FROM ps", EV, CUR, _LAG, _STATS)
def partition_stats(spark, d):
    return _stats(spark, d).select(*q.LANE, "consumer_group", "total", "pending", "processing", "completed", "dead")


@query("SELECT queue, partitions, total, pending, processing, completed, dead, round(avg_lag, 3) AS avg_lag, max_lag FROM qs", EV, CUR, _LAG, _STATS)
def queue_rollup(spark, d):
    return a.queue_stats(_stats(spark, d)).withColumn("avg_lag", F.round("avg_lag", 3))


def _named(stats: DataFrame) -> DataFrame:
    return stats.withColumn("namespace", F.when(F.col("queue").isin("error", "view"), "web").otherwise("app"))


@query("SELECT CASE WHEN queue IN ('error', 'view') THEN 'web' ELSE 'app' END AS namespace, count(*) AS queues, sum(partitions)::BIGINT AS partitions, sum(total)::BIGINT AS total, sum(pending)::BIGINT AS pending, sum(processing)::BIGINT AS processing, sum(completed)::BIGINT AS completed, sum(dead)::BIGINT AS dead FROM qs GROUP BY 1", EV, CUR, _LAG, _STATS)
def namespace_rollup(spark, d):
    return a.hierarchy_stats(_named(a.queue_stats(_stats(spark, d))), "namespace")


@query("SELECT count(*) AS queues, sum(total)::BIGINT AS total, sum(pending)::BIGINT AS pending, round(median(avg_lag), 3) AS median_lag FROM qs", EV, CUR, _LAG, _STATS)
def system_rollup_median(spark, d):
    return a.system_stats(a.queue_stats(_stats(spark, d))).select("queues", "total", "pending", F.round("median_lag", 3).alias("median_lag"))


@query("SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY r_name")
def hierarchy_rollup(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    per = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("b"))
    met = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left").join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return met.groupBy("r_name").agg(F.count_distinct("n_nationkey").alias("nations"), F.coalesce(F.sum("n"), F.lit(0)).alias("customers"), F.sum("b").cast("double").alias("balance"))


@query(f"SELECT created_at // {3600 * q.SECOND} * {3600 * q.SECOND} AS bucket, queue, count(*) AS n, round(count(*) / 3600.0, 2)::DOUBLE AS per_second, sum(k)::BIGINT AS ks FROM ev GROUP BY ALL", EV)
def throughput_buckets(spark, d):
    m = from_events(spark, d)
    hour = a.throughput(m, 3600, ("queue",))
    ks = m.groupBy(windows.floor_to(F.col("created_at"), 3600).alias("bucket"), "queue").agg(F.sum("payload.k").cast("long").alias("ks"))
    return hour.join(ks, ["bucket", "queue"])


@query(f"SELECT created_at // {DAY} * {DAY} AS bucket, sum(k + 1)::BIGINT AS n, round(sum(value * (k + 1))::DOUBLE / sum(k + 1), 2) AS avg_lag FROM ev GROUP BY 1", EV)
def weighted_lag(spark, d):
    out = a.throughput(from_events(spark, d), 86400, n=F.col("payload.k") + 1, lag_ms=F.col("payload.value"))
    return out.select("bucket", F.col("n").cast("long"), "avg_lag")


@query(f"SELECT created_at // {DAY} * {DAY} AS bucket, count(*) FILTER (WHERE queue = 'error') AS error, count(*) FILTER (WHERE queue = 'click') AS click, count(*) AS total FROM ev GROUP BY 1", EV)
def retention_pivot(spark, d):
    return a.pivot_counts(from_events(spark, d), 86400, "queue", ["error", "click"])


@query(f"SELECT queue, partition, max(row(created_at, id))[2] AS id, max(created_at) AS created_at FROM ev WHERE created_at >= {SECOND_CUT} GROUP BY queue, partition", EV)
def latest_per_key(spark, d):
    return a.latest(lanes_only(from_events(spark, d)), q.LANE, SECOND_CUT).drop("transaction_id")


@query(f"SELECT created_at // {DAY} * {DAY} AS bucket, queue, count(*) AS n, min(value)::DOUBLE AS low, max(value)::DOUBLE AS high, arg_max(value, row(created_at, id))::DOUBLE AS last FROM ev GROUP BY ALL", EV)
def metric_samples(spark, d):
    rows = from_events(spark, d).withColumn("value", F.col("payload.value").cast("double"))
    return a.samples(rows, 86400, ["queue"], "value").drop("avg")


@query("SELECT partition, round(avg(value), 4) AS avg, min(value)::DOUBLE AS low, max(value)::DOUBLE AS high, max(created_at) AS last_seen FROM ev GROUP BY partition", EV)
def worker_health(spark, d):
    rows = from_events(spark, d).withColumn("value", F.col("payload.value"))
    out = a.health(rows, "partition", "value")
    return out.select("partition", F.round(F.col("avg").cast("double"), 4).alias("avg"), F.col("low").cast("double"), F.col("high").cast("double"), "last_seen")


@query(
    f"""SELECT b AS bucket, coalesce(sum(k) FILTER (WHERE queue = 'click'), 0)::BIGINT AS push_n, coalesce(round(sum(k) FILTER (WHERE queue = 'click') / count(*) FILTER (WHERE queue = 'click'), 2), 0)::DOUBLE AS push_batch,
  coalesce(sum(k) FILTER (WHERE queue = 'view'), 0)::BIGINT AS pop_n, coalesce(sum(k) FILTER (WHERE queue = 'signup'), 0)::BIGINT AS ack_n
  FROM (SELECT unnest(range({FIRST}, {SECOND_CUT + 1}, {6 * 3600 * q.SECOND})) AS b) s LEFT JOIN ev ON created_at // {6 * 3600 * q.SECOND} * {6 * 3600 * q.SECOND} = b AND created_at BETWEEN {FIRST} AND {SECOND_CUT} GROUP BY b""",
    EV,
)
def status_series(spark, d):
    m = from_events(spark, d)
    part = lambda kind: m.filter(F.col("queue") == kind).select("created_at", F.col("payload.k").cast("long").alias("n"), F.lit(1).alias("requests"))
    return a.status_series(part("click"), part("view"), part("signup"), FIRST, SECOND_CUT).select("bucket", "push_n", "push_batch", "pop_n", "ack_n")


@query(
    f"""SELECT (SELECT count(DISTINCT queue) FROM ev) AS queues, (SELECT count(*) FROM (SELECT DISTINCT queue, partition FROM ev)) AS partitions, (SELECT count(*) FROM ev) AS messages,
  (SELECT round(count(*) FILTER (WHERE created_at >= {NOW - 3 * DAY}) / {3 * 86400}.0, 2)::DOUBLE FROM ev) AS per_second, (SELECT sum(lag)::BIGINT FROM l) AS pending, (SELECT max(lag_seconds) FROM l) AS max_lag_seconds, (SELECT count(*) FROM ev WHERE queue = 'error') AS dead""",
    EV, CUR, _LAG,
)
def overview(spark, d):
    m = from_events(spark, d)
    return a.overview(lanes_only(m), cursors(m), dead(m), NOW, 3 * 86400)


_TR = "tr AS (SELECT conv_id * 1000 + turn AS trace_id, conv_id AS message_id, conv_id * 1000 + turn AS created_at, CASE WHEN turn % 2 = 0 THEN [role, 'even'] ELSE [role] END AS names FROM conversations)"


def traces(spark, d) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet")
    place_ = F.col("conv_id") * 1000 + F.col("turn")
    names = F.when(F.col("turn") % 2 == 0, F.array("role", F.lit("even"))).otherwise(F.array("role"))
    return c.select(place_.alias("trace_id"), F.col("conv_id").alias("message_id"), place_.alias("created_at"), names.alias("names"))


@query("SELECT name, count(*) AS traces, count(DISTINCT message_id) AS messages, max(created_at) AS last_seen FROM (SELECT *, unnest(names) AS name FROM tr) GROUP BY name", _TR)
def trace_names(spark, d):
    return a.trace_names(traces(spark, d))


@query("SELECT trace_id, message_id, (SELECT count(*) FROM tr WHERE list_contains(names, 'even')) AS total FROM tr WHERE list_contains(names, 'even')", _TR)
def traces_by_name(spark, d):
    return a.traces_by_name(traces(spark, d), "even").select("trace_id", "message_id", "total")


@query("SELECT trace_id, array_to_string(list_sort(names), ',') AS names FROM tr WHERE message_id = 3", _TR)
def message_traces(spark, d):
    return a.message_traces(traces(spark, d), 3).select("trace_id", F.array_join("names", ",").alias("names"))


@query(f"SELECT queue, partition, count(*) AS n FROM ev GROUP BY queue, partition", EV)
def incremental_counts(spark, d):
    m = lanes_only(from_events(spark, d))
    old = q.zone_map(m.filter(F.col("created_at") <= FIRST)).select(*q.LANE, "n", F.col("newest").alias("upto"))
    return a.incremental_counts(m, old).select(*q.LANE, "n")


@query(
    f"""SELECT consumer_group, queue, min(start_at) AS start_at FROM (SELECT 'a' AS consumer_group, queue, {FIRST} AS start_at FROM qn WHERE queue = 'error' UNION ALL SELECT 'a', queue, {SECOND_CUT} FROM qn WHERE namespace = 'web'
  UNION ALL SELECT 'b', queue, {NOW} FROM qn WHERE task = 't1') GROUP BY consumer_group, queue""",
    EV, "qn AS (SELECT DISTINCT queue, CASE WHEN queue IN ('error', 'view') THEN 'web' ELSE 'app' END AS namespace, CASE WHEN queue IN ('click', 'view') THEN 't1' ELSE 't2' END AS task FROM ev)",
)
def subscription_resolution(spark, d):
    names = _named(from_events(spark, d).select("queue").distinct()).withColumn("task", F.when(F.col("queue").isin("click", "view"), "t1").otherwise("t2"))
    subs = spark.createDataFrame([("a", "error", None, None, FIRST), ("a", "", "web", None, SECOND_CUT), ("b", None, None, "t1", NOW), ("c", "nowhere", None, None, NOW)], "consumer_group string, queue string, namespace string, task string, start_at long")
    return q.subscriptions(names, subs)


@query("SELECT coalesce(CASE WHEN k % 10 <> 0 THEN (k % 10)::VARCHAR END, 'null_key') AS key, count(*) AS n, sum(k)::BIGINT AS ks FROM ev GROUP BY 1", EV)
def grouped_by_path(spark, d):
    k = F.col("payload.k")
    return a.grouped_by_path(from_events(spark, d), F.when(k % 10 != 0, k % 10), n=F.count(F.lit(1)), ks=F.sum(k).cast("long"))


@query(f"SELECT queue, n::BIGINT AS total, (n - o)::DOUBLE / {(SECOND_CUT - FIRST) // q.SECOND} AS rate FROM (SELECT queue, count(*) FILTER (WHERE created_at <= {SECOND_CUT}) AS n, count(*) FILTER (WHERE created_at <= {FIRST}) AS o FROM ev GROUP BY queue)", EV)
def rate_snapshots(spark, d):
    m = from_events(spark, d)
    shot = lambda t: m.filter(F.col("created_at") <= t).groupBy("queue").agg(F.count("*").alias("total")).withColumn("at", F.lit(t))
    return a.rates(shot(SECOND_CUT), shot(FIRST)).drop("at")


@query("SELECT partition, count(*) AS n, round(sum(k)::DOUBLE / count(*), 6) AS avg, min(k)::BIGINT AS low, max(k)::BIGINT AS high FROM ev GROUP BY partition", EV)
def merged_samples(spark, d):
    rows = from_events(spark, d).withColumn("k", F.col("payload.k").cast("long"))
    parts = a.samples(rows, 3600, ["partition"], "k")
    return a.merged_samples(parts, ["partition"]).withColumn("avg", F.round("avg", 6))


@query("SELECT queue, quantile_disc(k, 0.5)::BIGINT AS p50, quantile_disc(k, 0.95)::BIGINT AS p95, quantile_disc(k, 0.99)::BIGINT AS p99 FROM ev GROUP BY queue", EV)
def latency_percentiles(spark, d):
    rows = from_events(spark, d).withColumn("k", F.col("payload.k").cast("long"))
    return a.percentiles(rows, "k", ["queue"])


# --- relational idioms and scalars ------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def semi_exists(spark, d):
    o, l = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    return o.join(l.filter("l_quantity > 49"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def anti_not_exists(spark, d):
    c, o = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "orders"))
    return c.join(o.filter("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer")
def union_distinct(spark, d):
    c, o = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "orders"))
    return o.select(F.col("o_custkey").alias("key")).union(c.select("c_custkey")).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
def topk_offset(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(50).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey")
def lateral_top1(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query("SELECT id, lower(lpad(to_hex(created_at // 1000), 12, '0')[1:8] || '-' || lpad(to_hex(created_at // 1000), 12, '0')[9:12]) || '-7000-8000-000000000000' AS boundary, created_at // 1000 * 1000 AS back FROM ev", EV)
def uuid7_bounds(spark, d):
    out = from_events(spark, d).select("id", scalars.uuid7_boundary(F.col("created_at")).alias("boundary"))
    return out.withColumn("back", scalars.uuid7_micros(F.col("boundary")))


@query("SELECT id, strftime(make_timestamp(created_at), '%Y-%m-%dT%H:%M:%S.') || lpad((created_at // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS iso FROM ev", EV)
def iso_times(spark, d):
    return from_events(spark, d).select("id", scalars.iso_millis(F.col("created_at")).alias("iso"))


@query(f"SELECT id, {NOW} - (k * 60)::BIGINT * 1000000 AS ago, CASE WHEN k % 2 = 0 THEN k * 1000000 ELSE NULL END::BIGINT AS unix FROM ev", EV)
def relative_times(spark, d):
    k = F.col("payload.k").cast("string")
    rows = from_events(spark, d)
    return rows.select("id", scalars.relative_time(F.concat(k, F.lit("m ago")), F.lit(NOW)).alias("ago"), scalars.relative_time(F.when(F.col("payload.k") % 2 == 0, k).otherwise("soon"), F.lit(NOW)).alias("unix"))


@query("SELECT event_id AS id, regexp_extract(props, '\"k\": *([0-9]+)', 1) AS k FROM events")
def json_paths(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), scalars.json_path(F.col("props"), "k").alias("k"))


@query("SELECT event_id AS id, props FROM events")
def sealed_payloads(spark, d):
    key = F.lit("0123456789abcdef0123456789abcdef")
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), scalars.encrypt(F.col("props"), key).alias("sealed"))
    return rows.select("id", scalars.decrypt(F.col("sealed"), key).alias("props"))


# --- what the queue's own tables would hold, made of the events ---------------------------------------


@query(f"SELECT bucket, queue, count(*) AS pop_count, sum(k) AS lag_ms, max(k) AS max_lag_ms FROM (SELECT created_at // 60000000 * 60000000 AS bucket, queue, k FROM ev) WHERE bucket BETWEEN {FIRST} AND {SECOND_CUT} AND queue = 'error' GROUP BY bucket, queue", EV)
def queue_lag_rows(spark, d):
    rows = from_events(spark, d).withColumn("k", F.col("payload.k")).groupBy(F.expr("created_at div 60000000 * 60000000").alias("bucket"), "queue")
    rows = rows.agg(F.count("*").alias("pop_count"), F.sum("k").alias("lag_ms"), F.max("k").alias("max_lag_ms"))
    return a.queue_lag(rows, FIRST, SECOND_CUT, "error")


@query(f"SELECT created_at // 21600000000 * 21600000000 AS bucket, queue, 'h' || user_id % 3 AS hostname, k % 2 AS worker_id, round(avg(CASE WHEN id % 4 = 0 THEN 0 ELSE k END)::DOUBLE, 2) AS parked FROM ev WHERE created_at BETWEEN {FIRST} AND {NOW} GROUP BY ALL", EV)
def parked_replicas(spark, d):
    m = from_events(spark, d)
    rows = m.select("created_at", "queue", F.concat(F.lit("h"), (F.col("partition").cast("long") % 3).cast("string")).alias("hostname"), (F.col("payload.k") % 2).alias("worker_id"), F.when(F.col("id") % 4 != 0, F.col("payload.k")).alias("parked"))
    return a.parked(rows, FIRST, NOW)


@query(
    """SELECT pos // 60000000 * 60000000 AS bucket, coalesce(CASE WHEN gone = 0 OR queue <> 'error' THEN queue END, '__orphaned__') AS queue, sum(1 - gone) AS partitions_created, sum(gone) AS partitions_deleted
  FROM (SELECT queue, min(created_at) AS pos, 0 AS gone FROM ev GROUP BY queue, partition UNION ALL SELECT queue, max(created_at), 1 FROM ev GROUP BY queue, partition) GROUP BY 1, 2""",
    EV,
)
def partition_lifecycle(spark, d):
    lanes = from_events(spark, d).groupBy(*q.LANE).agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    return a.lifecycle(lanes.select("queue", F.col("first").alias("at")), lanes.select(F.when(F.col("queue") != "error", F.col("queue")).alias("queue"), F.col("last").alias("at")))


@query(
    f"""SELECT id AS idx, CASE WHEN k % 2 = 0 THEN 'g' ELSE '{q.QUEUE_MODE}' END AS consumer_group, CASE WHEN k % 3 = 0 THEN 'step' ELSE 'info' END AS event_type, CASE WHEN k % 5 <> 0 THEN id END AS message_id,
  CASE WHEN k % 7 = 0 THEN '' ELSE 'all,k' || k END AS names, CASE WHEN k % 5 = 0 THEN 'Message not found' END AS error FROM ev""",
    EV,
)
def traces_recorded(spark, d):
    m, k = from_events(spark, d), F.col("payload.k")
    names = F.when(k % 7 != 0, F.array(F.lit("all"), F.concat(F.lit("k"), k.cast("string")), F.lit("all")))
    events = m.select(F.col("id").alias("idx"), *q.LANE, F.when(k % 5 == 0, "nobody").otherwise(F.col("transaction_id")).alias("transaction_id"), F.when(k % 2 == 0, "g").alias("consumer_group"), F.when(k % 3 == 0, "step").alias("event_type"), F.lit(None).cast("string").alias("data"), F.lit("w").alias("worker"), names.alias("names"))
    out = a.record_traces(lanes_only(m), events)
    return out.select("idx", "consumer_group", "event_type", "message_id", F.array_join("names", ",").alias("names"), "error")


@query(
    """SELECT id AS idx, coalesce(CASE WHEN k % 2 = 0 THEN 'own' END, split_part(name, '.', 1)) AS namespace, coalesce(CASE WHEN k % 3 = 0 THEN 'mine' END, split_part(name, '.', 2)) AS task, CASE WHEN k % 4 = 0 THEN partition ELSE 'Default' END AS partition
  FROM (SELECT *, CASE WHEN k % 5 = 0 THEN queue ELSE queue || '.t' || k END AS name FROM ev)""",
    EV,
)
def push_defaults(spark, d):
    m, k = from_events(spark, d), F.col("payload.k")
    name = F.when(k % 5 == 0, F.col("queue")).otherwise(F.concat("queue", F.lit(".t"), k.cast("string")))
    items = m.select(F.col("id").alias("idx"), name.alias("queue"), F.when(k % 4 == 0, F.col("partition")).alias("partition"), F.when(k % 2 == 0, "own").alias("namespace"), F.when(k % 3 == 0, "mine").alias("task"))
    return q.with_defaults(items).select("idx", "namespace", "task", "partition")


@query(f"SELECT queue, partition, consumer_group, CASE WHEN consumer_group = 'beta' THEN {NOW + 2 * DAY} END AS lease_until FROM cur", EV, CUR)
def lease_renewed(spark, d):
    c = cursors(from_events(spark, d))
    return q.renew(c, "w1", NOW, 2 * 86400).select(*q.LANE, "consumer_group", "lease_until")


@query("SELECT count(*) AS messages, sum(k) AS k FROM ev", EV)
def running_totals(spark, d):
    return a.totals(from_events(spark, d).select(F.lit(1).alias("messages"), F.col("payload.k").alias("k")), ["messages", "k"])


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

