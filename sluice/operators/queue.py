"""Log operators as functions over tables: append with dedup, cursor reads, acknowledgement, replay, retention.

Mutation is rewriting: each function returns the new rows or the new table, and the caller commits them
(see sluice.streaming.commit). Times are microseconds; `now` is always given, never read from a clock.
Cursors are rows of (queue, partition, consumer_group); a message is consumed if (created_at, id) is not
after the cursor's (last_at, last_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SECOND = 1_000_000
#: Reserved group of competing consumers; any other group gets a full copy.
QUEUE_MODE = "__QUEUE_MODE__"
#: Options of a queue and their defaults (fixed values). retry_delay, ttl, priority, max_queue_size and the dead-letter flags are stored and change nothing.
QUEUE_DEFAULTS = {
    "namespace": "", "task": "", "priority": 0, "lease_seconds": 300, "retry_limit": 3, "retry_delay": 1000, "max_queue_size": 0, "ttl": 3600,
    "dead_letter_queue": False, "dlq_after_max_retries": False, "delayed_processing": 0, "window_buffer": 0, "retention_seconds": 0,
    "completed_retention_seconds": 0, "retention_enabled": False, "encryption_enabled": False, "max_wait_seconds": 0,
}
LANE = ["queue", "partition"]


def place(at: str = "created_at", id_: str = "id", of: str | None = None) -> Column:
    """The order inside a partition, as one comparable value."""
    col = (lambda c: F.col(f"{of}.{c}")) if of else F.col
    return F.struct(col(at).alias("at"), col(id_).alias("id"))


# --- push -------------------------------------------------------------------------------------------


def with_defaults(items: DataFrame) -> DataFrame:
    """Fills an item's defaults: the partition, a transaction id of its own, an empty payload; namespace and task, where not given, from a dotted queue name."""
    has = set(items.columns)
    col = lambda c, default: F.coalesce(F.col(c), default) if c in has else default
    parts = F.split("queue", r"\.")
    return (
        items.withColumn("partition", col("partition", F.lit("Default")))
        .withColumn("transaction_id", col("transaction_id", F.uuid()))
        .withColumn("payload", col("payload", F.lit("{}")))
        .withColumn("namespace", col("namespace", F.get(parts, 0)))
        .withColumn("task", col("task", F.coalesce(F.get(parts, 1), F.lit(""))))
    )


def push(stored: DataFrame, items: DataFrame) -> DataFrame:
    """items (idx, id, queue, partition, transaction_id, ..) with status `queued` or `duplicate` and message_id: the winner's id.

    Within the batch the smallest idx of a transaction wins, against stored rows the stored one does.
    """
    key = [*LANE, "transaction_id"]
    first = items.groupBy(*key).agg(F.min_by("id", "idx").alias("_batch_id"), F.min("idx").alias("_batch_idx"))
    known = stored.join(items.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.min("id").alias("_stored_id"))
    met = items.join(first, key).join(known, key, "left")
    wins = F.col("_stored_id").isNull() & (F.col("idx") == F.col("_batch_idx"))
    return met.select(*items.columns, F.when(wins, "queued").otherwise("duplicate").alias("status"), F.coalesce("_stored_id", "_batch_id").alias("message_id"))


def appended(pushed: DataFrame) -> DataFrame:
    """The rows of a push that are new."""
    return pushed.filter("status = 'queued'").drop("status", "message_id", "idx")


# --- pop --------------------------------------------------------------------------------------------


def zone_map(messages: DataFrame) -> DataFrame:
    """Newest place and count of each lane."""
    return messages.groupBy(*LANE).agg(F.max(place()).alias("newest"), F.count("*").alias("n"))


def start_places(lanes: DataFrame, cursors: DataFrame, group: str, start_at: Column | None = None, now: int | None = None, mode: str = "all") -> DataFrame:
    """lanes with last_at and last_id: the group's cursor, else its subscription's start, else the beginning.

    A new group in mode `new` or `now` starts at now; the queue-mode group always starts at the beginning.
    """
    mine = cursors.filter(F.col("consumer_group") == group).select(*LANE, "last_at", "last_id", *(c for c in ("lease_until",) if c in cursors.columns))
    fresh = F.lit(None).cast("long")
    if group != QUEUE_MODE:
        fresh = F.coalesce(start_at if start_at is not None else F.lit(None).cast("long"), F.lit(now).cast("long") if mode in ("new", "now") else F.lit(None).cast("long"))
    joined = lanes.join(mine, LANE, "left")
    return joined.withColumn("last_at", F.coalesce("last_at", fresh)).withColumn("last_id", F.coalesce("last_id", F.when(F.col("last_at").isNotNull(), F.lit(2**63 - 1))))


def unread(messages: DataFrame, cursors: DataFrame, group: str, **start) -> DataFrame:
    """Messages after the group's cursor. The comparison is a residual of an equi-join, so lanes stay co-located."""
    lanes = start_places(messages.select(*LANE).distinct(), cursors, group, **start)
    met = messages.join(lanes, LANE)
    after = F.col("last_at").isNull() | (place() > place("last_at", "last_id"))
    return met.filter(after).select(*messages.columns)


def ready(messages: DataFrame, now: int, delayed: int = 0, buffer: int = 0) -> DataFrame:
    """Messages older than the queue's delay, of lanes whose newest message is older than its buffer (debounce)."""
    out = messages.filter(F.col("created_at") <= now - delayed * SECOND) if delayed else messages
    if buffer:
        still = messages.groupBy(*LANE).agg(F.max("created_at").alias("_new")).filter(F.col("_new") <= now - buffer * SECOND)
        out = out.join(still.select(*LANE), LANE, "left_semi")
    return out


def pop(messages: DataFrame, cursors: DataFrame, group: str, batch: int, now: int = 0, delayed: int = 0, buffer: int = 0, **start) -> DataFrame:
    """The next `batch` messages of every lane."""
    rows = ready(unread(messages, cursors, group, now=now, **start), now, delayed, buffer)
    order = W.partitionBy(*LANE).orderBy("created_at", "id")
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= batch)


def pop_global(messages: DataFrame, cursors: DataFrame, group: str, batch: int, max_lanes: int, now: int = 0, delayed: int = 0, buffer: int = 0, **start) -> DataFrame:
    """At most `batch` messages in all from at most `max_lanes` lanes without a live lease.

    Lanes come least recently consumed first (never consumed before all), then by name. Only max_lanes lane
    counts, a bound of the request, are put in one order.
    """
    rows = ready(unread(messages, cursors, group, now=now, **start), now, delayed, buffer)
    mine = cursors.filter(F.col("consumer_group") == group)
    held = mine.filter(F.col("lease_until") > now).select(*LANE) if "lease_until" in cursors.columns else None
    rows = rows.join(held, LANE, "left_anti") if held is not None else rows
    lanes = rows.groupBy(*LANE).agg(F.count("*").alias("_n")).join(mine.select(*LANE, "last_at"), LANE, "left")
    order = ["last_at", "queue", "partition"]
    few = lanes.orderBy(*[F.asc_nulls_first(c) for c in order]).limit(max_lanes)
    before = W.orderBy(*[F.asc_nulls_first(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)
    few = few.select(*LANE, F.coalesce(F.sum(F.least(F.col("_n"), F.lit(batch))).over(before), F.lit(0)).alias("_before")).filter(F.col("_before") < batch)
    each = W.partitionBy(*LANE).orderBy("created_at", "id")
    taken = rows.join(F.broadcast(few), LANE).withColumn("rn", F.row_number().over(each))
    return taken.filter(F.col("_before") + F.col("rn") <= batch).drop("_before")


def lease(popped: DataFrame, cursors: DataFrame, group: str, worker: str, now: int, seconds: int | None = None, queue_seconds: int | None = None, auto_ack: bool = False) -> DataFrame:
    """The cursor rows that a pop writes: leased for the request's, the queue's or 60 seconds, or moved at once with auto_ack."""
    span = next(x for x in (seconds, queue_seconds, 60) if x is not None) * SECOND
    taken = popped.groupBy(*LANE).agg(F.count("*").cast("int").alias("batch_size"), F.max(place()).alias("_last"))
    mine = cursors.filter(F.col("consumer_group") == group).select(*LANE, "last_at", "last_id", "retries")
    rows = taken.join(mine, LANE, "left")
    last = lambda c, f: F.col(f"_last.{f}") if auto_ack else F.col(c)
    return rows.select(
        *LANE, F.lit(group).alias("consumer_group"), last("last_at", "at").alias("last_at"), last("last_id", "id").alias("last_id"),
        F.lit(None if auto_ack else now + span).cast("long").alias("lease_until"), F.lit(None if auto_ack else worker).cast("string").alias("worker"),
        "batch_size", F.lit(0).alias("acked"), F.coalesce("retries", F.lit(0)).alias("retries"),
    )


def renew(cursors: DataFrame, worker: str, now: int, seconds: int = 60) -> DataFrame:
    """cursors with the worker's live leases extended, never shortened."""
    live = (F.col("worker") == worker) & (F.col("lease_until") > now)
    return cursors.withColumn("lease_until", F.when(live, F.greatest("lease_until", F.lit(now + seconds * SECOND))).otherwise(F.col("lease_until")))


# --- ack --------------------------------------------------------------------------------------------


def validated(acks: DataFrame, messages: DataFrame, cursors: DataFrame, now: int) -> DataFrame:
    """acks (idx, queue, partition, transaction_id, consumer_group, worker, status) with the message's place and `error` (null: accepted)."""
    found = messages.select(*LANE, "transaction_id", F.col("created_at").alias("_at"), F.col("id").alias("_id"))
    held = cursors.select(*LANE, "consumer_group", F.col("worker").alias("_worker"), F.col("lease_until").alias("_until"), "retries", "batch_size", "acked")
    met = acks.join(found, [*LANE, "transaction_id"], "left").join(held, [*LANE, "consumer_group"], "left")
    live = F.col("worker").isNull() | (F.coalesce(F.col("_worker") == F.col("worker"), F.lit(False)) & F.coalesce(F.col("_until") > now, F.lit(False)))
    return met.withColumn("error", F.when(F.col("_at").isNull(), "Message not found").when(~live, "Invalid or expired lease"))


def _folded(accepted: DataFrame) -> DataFrame:
    """Per lane `_state`: what its accepted acks, taken in the order of their messages, make of the cursor, and the rows they dead-letter.

    A lane's acks are folded as one list: those of a batch, which its lease bounds.
    """
    lane = [*LANE, "consumer_group"]
    held = F.first(F.struct(F.col("_until").alias("lease_until"), F.col("_worker").alias("worker"), F.coalesce("acked", F.lit(0)).alias("acked"), F.coalesce("batch_size", F.lit(0)).alias("batch_size"), F.coalesce("retries", F.lit(0)).alias("retries"))).alias("_held")
    acks = F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_id").alias("id"), "status", "retry_limit", "reason"))).alias("_acks")
    per = accepted.filter(F.col("error").isNull()).groupBy(*lane).agg(held, acks)
    dead = "array<struct<id:bigint,error:string,retry_count:int>>"
    start = F.struct(
        F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("id"), F.col("_held.lease_until").cast("long").alias("lease_until"), F.col("_held.worker").cast("string").alias("worker"),
        *[F.col(f"_held.{c}").cast("int").alias(c) for c in ("acked", "batch_size", "retries")], F.array().cast(dead).alias("dead"),
    )

    def step(s, e):
        done, failed = e["status"].isin("completed", "success"), e["status"] == "failed"
        gone = (e["status"] == "dlq") | (failed & (s["retries"] >= e["retry_limit"]))
        again = failed & ~gone & s["worker"].isNotNull()
        moves, full = done | gone, (s["batch_size"] > 0) & (s["acked"] + 1 >= s["batch_size"])
        free = (moves & full) | again | (e["status"] == "retry")
        letter = F.struct(e["id"].cast("long").alias("id"), F.coalesce(e["reason"], F.lit("Retries exhausted")).alias("error"), s["retries"].alias("retry_count"))
        out = {
            "at": F.when(moves, e["at"].cast("long")).otherwise(s["at"]), "id": F.when(moves, e["id"].cast("long")).otherwise(s["id"]),
            "lease_until": F.when(~free, s["lease_until"]), "worker": F.when(~free, s["worker"]),
            "acked": F.when(again | (moves & full), 0).when(moves, s["acked"] + 1).otherwise(s["acked"]),
            "batch_size": F.when(again, 0).otherwise(s["batch_size"]),
            "retries": F.when(again, s["retries"] + 1).when(done & full, 0).otherwise(s["retries"]),
            "dead": F.when(gone, F.concat(s["dead"], F.array(letter).cast(dead))).otherwise(s["dead"]),
        }
        return F.struct(*[c.alias(k) for k, c in out.items()])

    return per.select(*lane, F.aggregate("_acks", start, step).alias("_state"))


def ack(cursors: DataFrame, accepted: DataFrame, now: int) -> DataFrame:
    """cursors after accepted acks, each lane's in the order of its messages.

    `completed` (or `success`) and dead-lettered rows move the cursor, never back, and count towards the batch; the
    row that completes it frees the lease, and the retries begin anew if it was a completed one. A `failed` row with
    retries left frees the lease, drops the batch and counts a retry, if the lane has a worker; `retry` frees the lease.
    """
    lane = [*LANE, "consumer_group"]
    met = cursors.join(_folded(accepted), lane, "left")
    to = F.greatest(F.struct(F.col("last_at").cast("long").alias("at"), F.col("last_id").cast("long").alias("id")), F.when(F.col("_state.at").isNotNull(), F.struct(F.col("_state.at").alias("at"), F.col("_state.id").alias("id"))))
    acked = F.col("_state").isNotNull()
    out = {"last_at": F.coalesce(to["at"], "last_at"), "last_id": F.coalesce(to["id"], "last_id")}
    out |= {c: F.when(acked, F.col(f"_state.{c}")).otherwise(F.col(c)) for c in ("lease_until", "worker", "acked", "batch_size", "retries")}
    return met.select(*[out[c].alias(c) if c in out else F.col(c) for c in cursors.columns])


def dead_letters(accepted: DataFrame, now: int) -> DataFrame:
    """The dead-letter rows of accepted acks: status `dlq`, or `failed` when the retries are spent."""
    gone = _folded(accepted).select(*LANE, "consumer_group", F.explode("_state.dead").alias("_d"))
    return gone.select("_d.id", *LANE, "consumer_group", "_d.error", "_d.retry_count", F.lit(now).cast("long").alias("failed_at"))


def transaction(messages: DataFrame, items: DataFrame, cursors: DataFrame, acks: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """All or nothing: the new messages and the new cursors. A duplicate push or a rejected ack raises, and nothing is committed."""
    pushed = push(messages, items)
    if not pushed.filter("status = 'duplicate'").isEmpty():
        raise ValueError("a pushed transaction id exists already")
    checked = validated(acks, messages, cursors, now)
    if not checked.filter(F.col("error").isNotNull()).isEmpty():
        raise ValueError("an acknowledgement was rejected")
    return messages.unionByName(appended(pushed).select(*messages.columns)), ack(cursors, checked, now)


# --- groups -----------------------------------------------------------------------------------------


def has_pending(messages: DataFrame, cursors: DataFrame, group: str, queue: str | None = None, partition: str | None = None) -> bool:
    rows = messages if queue is None else messages.filter(F.col("queue") == queue)
    rows = rows if partition is None else rows.filter(F.col("partition") == partition)
    lanes = start_places(zone_map(rows), cursors, group)
    return not lanes.filter(F.col("last_at").isNull() | (F.col("newest") > place("last_at", "last_id"))).isEmpty()


def seek(messages: DataFrame, cursors: DataFrame, group: str, queue: str | None = None, ts: int | None = None, partition: str | None = None) -> DataFrame:
    """The group's cursors at the last message not after ts, or at the end without ts. A lane with none is reset to its start (nulls)."""
    rows = messages if queue is None else messages.filter(F.col("queue") == queue)
    rows = rows if partition is None else rows.filter(F.col("partition") == partition)
    upto = F.lit(True) if ts is None else F.col("created_at") <= ts
    found = rows.groupBy(*LANE).agg(F.max(F.when(upto, place())).alias("_to"))
    return found.select(*LANE, F.lit(group).alias("consumer_group"), F.col("_to.at").alias("last_at"), F.col("_to.id").alias("last_id"))


def subscriptions(queues: DataFrame, subs: DataFrame) -> DataFrame:
    """(consumer_group, queue, start_at): each group's start on each queue (queue, namespace, task) it subscribes to.

    A subscription names a queue, or leaves it blank and names a namespace or a task: a wildcard. The three
    ways are equi-joins whose results are united; where several match, the earliest start holds.
    """
    blank = F.coalesce("queue", F.lit("")) == ""
    named = subs.filter(~blank).select("consumer_group", "queue", "start_at").join(queues.select("queue"), "queue")
    by = lambda c: subs.filter(blank & (F.coalesce(c, F.lit("")) != "")).select("consumer_group", c, "start_at").join(queues.select("queue", c), c)
    cols = ["consumer_group", "queue", "start_at"]
    met = named.select(*cols).union(by("namespace").select(*cols)).union(by("task").select(*cols))
    return met.groupBy("consumer_group", "queue").agg(F.min("start_at").alias("start_at"))


def consume(handler, each: bool = False):
    """A foreachBatch function that hands a micro-batch to a handler, whole or by partition; the stream's checkpoint acknowledges it when the handler returns."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if each:
            batch.foreachPartition(lambda rows: [handler(r) for r in rows] and None)
        else:
            handler(batch)

    return run


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with rows in place of those with their keys; columns that rows lack are null."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows, allowMissingColumns=True).select(*table.columns)


def delete_group(cursors: DataFrame, group: str, queue: str | None = None) -> DataFrame:
    gone = F.col("consumer_group") == group
    return cursors.filter(~(gone if queue is None else gone & (F.col("queue") == queue)))


def configure(queues: DataFrame, name: str, **options) -> DataFrame:
    """queues with one row written anew: the given options, and defaults for all others."""
    unknown = set(options) - set(QUEUE_DEFAULTS)
    if unknown:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    row = QUEUE_DEFAULTS | options | {"name": name}
    cells = [F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in queues.schema.fields]
    new = queues.sparkSession.range(1).select(*cells)
    return queues.filter(F.col("name") != name).unionByName(new)


def delete_queue(table: DataFrame, queue: str) -> DataFrame:
    """Any table with a queue column, without the queue."""
    return table.filter(F.col("queue") != queue)


def delete_message(messages: DataFrame, queue: str, partition: str, transaction_id: str) -> DataFrame:
    return messages.filter(~((F.col("queue") == queue) & (F.col("partition") == partition) & (F.col("transaction_id") == transaction_id)))


# --- retention --------------------------------------------------------------------------------------


def expired(messages: DataFrame, now: int, retention: Column | int) -> DataFrame:
    """Messages older than the retention (seconds; a column may hold each queue's, 0 or null: keep)."""
    seconds = (F.lit(retention) if isinstance(retention, int) else retention).cast("long")
    return messages.filter((seconds > 0) & (F.col("created_at") < now - seconds * SECOND))


def completed(messages: DataFrame, cursors: DataFrame, now: int, retention: int) -> DataFrame:
    """Messages that every group of the lane has consumed and that are older than the retention."""
    low = cursors.filter(F.col("last_at").isNotNull()).groupBy(*LANE).agg(F.min(place("last_at", "last_id")).alias("_low"))
    met = messages.join(low, LANE)
    return met.filter((place() <= F.col("_low")) & (F.col("created_at") < now - retention * SECOND)).drop("_low")


def overdue(messages: DataFrame, cursors: DataFrame, now: int, max_wait: int) -> DataFrame:
    """Messages older than max_wait that some group of the lane (or, without groups, nobody) has yet to consume."""
    low = cursors.groupBy(*LANE).agg(F.min(F.when(F.col("last_at").isNotNull(), place("last_at", "last_id"))).alias("_low"), F.bool_or(F.col("last_at").isNull()).alias("_none"))
    met = messages.join(low, LANE, "left")
    pending = F.col("_low").isNull() | F.coalesce("_none", F.lit(False)) | (place() > F.col("_low"))
    return met.filter(pending & (F.col("created_at") < now - max_wait * SECOND)).drop("_low", "_none")


def dead_partitions(partitions: DataFrame, messages: DataFrame, now: int, days: int) -> DataFrame:
    """Lanes (queue, partition, created_at, last_activity, last_consumed) without messages whose latest time is older than the days."""
    idle = F.greatest("created_at", "last_activity", "last_consumed") < now - days * 86400 * SECOND
    return partitions.filter(idle).join(messages.select(*LANE).distinct(), LANE, "left_anti")


def older(table: DataFrame, column: str, now: int, days: int) -> DataFrame:
    """Rows that a retention of so many days deletes."""
    return table.filter(F.col(column) < now - days * 86400 * SECOND)


def keep(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return table.join(gone.select(*key), key, "left_anti")
