"""Operational analytics over log tables: status, lag, groups, time series, roll-ups, traces.

Plain functions from tables to one DataFrame plan. Lag joins are equi-joins on the lane with the place as
residual; top-1 queries are max_by aggregates; series are gap-filled by a left join from a sequence. Nothing
is limited unless a limit is asked for, and then it limits rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.queue import LANE, QUEUE_MODE, SECOND, place, zone_map
from sluice.operators.windows import floor_to

BUCKETS = {"minute": 60, "hour": 3600, "day": 86400}
#: Lag from which a group counts as lagging, in seconds.
LAGGING = 300


def share(a: Column, b: Column, digits: int | None = None) -> Column:
    x = F.try_divide(a.cast("double"), b.cast("double"))
    return x if digits is None else F.round(x, digits)


def wanted(rows: DataFrame, **equal) -> DataFrame:
    """rows filtered by the given columns; None leaves a column free."""
    for name, value in equal.items():
        rows = rows if value is None else rows.filter(F.col(name) == value)
    return rows


def bucket_seconds(start: int, end: int) -> int:
    """The bucket that fits a range: a minute for up to an hour, then 5 and 15 minutes, an hour, 6 hours."""
    hours = (end - start) / SECOND / 3600
    return next((s for h, s in ((1, 60), (6, 300), (24, 900), (168, 3600)) if hours <= h), 21600)


# --- messages ---------------------------------------------------------------------------------------


def messages_over_time(messages: DataFrame, start: int, end: int, interval: str = "hour", **equal) -> DataFrame:
    """(bucket, n) for every bucket of the range, zero where there is none."""
    size = BUCKETS[interval]
    rows = wanted(messages, **equal).filter(F.col("created_at").between(start, end))
    counts = rows.groupBy(floor_to(F.col("created_at"), size).alias("bucket")).agg(F.count("*").alias("n"))
    step = size * SECOND
    series = messages.sparkSession.range(start - start % step, end + 1, step).withColumnRenamed("id", "bucket")
    return series.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def status(messages: DataFrame, cursors: DataFrame, dead: DataFrame, now: int, group: str = QUEUE_MODE) -> DataFrame:
    """messages with status: dead_letter, completed, processing (its lane is leased), pending."""
    mine = cursors.filter(F.col("consumer_group") == group).select(*LANE, "last_at", "last_id", "lease_until")
    gone = dead.filter(F.col("consumer_group") == group).select(*LANE, "id").distinct().withColumn("_dead", F.lit(True))
    met = messages.join(mine, LANE, "left").join(gone, [*LANE, "id"], "left")
    ladder = (
        F.when(F.col("_dead"), "dead_letter")
        .when(F.col("last_at").isNotNull() & (place() <= place("last_at", "last_id")), "completed")
        .when(F.col("lease_until") > now, "processing")
        .otherwise("pending")
    )
    return met.select(*messages.columns, ladder.alias("status"))


def list_messages(messages: DataFrame, cursors: DataFrame, dead: DataFrame, now: int, limit: int | None = None, offset: int = 0, wanted_status: str | None = None, start: int | None = None, end: int | None = None, **equal) -> DataFrame:
    """Messages, newest first, with the lane's mode (queue, bus, hybrid or none), how many groups consumed each, and the final status. `end` covers its whole minute."""
    rows = wanted(messages, **equal)
    rows = rows if start is None else rows.filter(F.col("created_at") >= start)
    rows = rows if end is None else rows.filter(F.col("created_at") < end - end % (60 * SECOND) + 60 * SECOND)
    lane = cursors.groupBy(*LANE).agg(F.bool_or(F.col("consumer_group") == QUEUE_MODE).alias("_q"), F.count_if(F.col("consumer_group") != QUEUE_MODE).alias("groups"))
    modes = lane.select(*LANE, "groups", F.when(F.col("_q") & (F.col("groups") > 0), "hybrid").when(F.col("_q"), "queue").when(F.col("groups") > 0, "bus").otherwise("none").alias("mode"))
    groups = cursors.filter((F.col("consumer_group") != QUEUE_MODE) & F.col("last_at").isNotNull()).select(*LANE, F.struct(F.col("last_at").alias("at"), F.col("last_id").alias("id")).alias("_p"))
    reached = groups.groupBy(*LANE).agg(F.sort_array(F.collect_list("_p")).alias("_ps"))  # one place for each group of a lane
    based = status(rows, cursors, dead, now).join(modes, LANE, "left").join(reached, LANE, "left")
    done = F.coalesce(F.size(F.filter("_ps", lambda p: p >= place())), F.lit(0))
    done = F.when(done < 0, 0).otherwise(done)
    mode = F.coalesce("mode", F.lit("none"))
    final = F.when(F.col("status") == "dead_letter", "dead_letter").when((mode == "bus") & (done >= F.col("groups")), "completed").when((mode == "hybrid") & (F.col("status") == "completed") & (done < F.col("groups")), "processing").otherwise(F.col("status"))
    out = based.select(*messages.columns, mode.alias("mode"), F.coalesce("groups", F.lit(0)).alias("groups"), done.alias("consumed_by"), final.alias("status"))
    out = out if wanted_status is None else out.filter(F.col("status") == wanted_status)
    return out if limit is None else out.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def message_detail(messages: DataFrame, cursors: DataFrame, queue: str, partition: str, transaction_id: str) -> DataFrame:
    """One message with its groups: an array of (group, consumed)."""
    one = messages.filter((F.col("queue") == queue) & (F.col("partition") == partition) & (F.col("transaction_id") == transaction_id))
    met = one.join(cursors.select(*LANE, "consumer_group", "last_at", "last_id"), LANE, "left")
    seen = F.col("last_at").isNotNull() & (place() <= place("last_at", "last_id"))
    return met.groupBy(*messages.columns).agg(F.sort_array(F.collect_list(F.when(F.col("consumer_group").isNotNull(), F.struct("consumer_group", seen.alias("consumed"))))).alias("groups"))


def dead_letter_list(dead: DataFrame, messages: DataFrame, limit: int | None = None, offset: int = 0, **equal) -> DataFrame:
    """Dead letters with their messages, newest failure first."""
    met = wanted(dead, **equal).join(messages.select(*LANE, "id", "transaction_id", "created_at", "payload"), [*LANE, "id"])
    return met if limit is None else met.orderBy(F.desc("failed_at"), F.desc("id")).offset(offset).limit(limit)


# --- lag --------------------------------------------------------------------------------------------


def lag(messages: DataFrame, cursors: DataFrame, now: int) -> DataFrame:
    """(queue, partition, consumer_group, lag, oldest_at, lag_seconds): messages after each cursor; zero and nulls where there are none."""
    held = messages.select(*LANE, "created_at", "id")
    met = cursors.select(*LANE, "consumer_group", "last_at", "last_id").join(held, LANE, "left")
    behind = F.col("id").isNotNull() & (F.col("last_at").isNull() | (place() > place("last_at", "last_id")))
    out = met.groupBy(*LANE, "consumer_group").agg(F.count(F.when(behind, 1)).alias("lag"), F.min(F.when(behind, F.col("created_at"))).alias("oldest_at"))
    return out.withColumn("lag_seconds", F.floor((now - F.col("oldest_at")) / SECOND))


def consumer_groups(messages: DataFrame, cursors: DataFrame, now: int) -> DataFrame:
    """Per (group, queue): members (lanes), total lag, greatest lag in seconds, and state: Dead (no lane was ever read), Lagging or Stable."""
    lanes = lag(messages, cursors, now).join(cursors.select(*LANE, "consumer_group", "last_at"), [*LANE, "consumer_group"])
    out = lanes.groupBy("consumer_group", "queue").agg(
        F.count("*").alias("members"), F.sum("lag").alias("total_lag"), F.coalesce(F.max("lag_seconds"), F.lit(0)).alias("max_lag_seconds"), F.count("last_at").alias("_read")
    )
    state = F.when(F.col("_read") == 0, "Dead").when(F.col("max_lag_seconds") > LAGGING, "Lagging").otherwise("Stable")
    return out.withColumn("state", state).drop("_read")


def consumer_groups_fast(messages: DataFrame, cursors: DataFrame, now: int) -> DataFrame:
    """Per (group, queue) from the newest place of each lane alone: lanes that lag and the age of the newest unread message (a lower bound of the lag)."""
    met = cursors.join(zone_map(messages).drop("n"), LANE)
    lags = F.col("last_at").isNull() | (F.col("newest") > place("last_at", "last_id"))
    age = F.when(lags, F.floor((now - F.col("newest.at")) / SECOND))
    return met.groupBy("consumer_group", "queue").agg(F.count("*").alias("members"), F.count(F.when(lags, 1)).alias("partitions_with_lag"), F.coalesce(F.max(age), F.lit(0)).alias("max_time_lag"), F.lit(None).cast("long").alias("total_lag"))


def group_details(messages: DataFrame, cursors: DataFrame, group: str, now: int) -> DataFrame:
    """Per queue of a group its lanes, as an array of structs by name."""
    rows = lag(messages, cursors.filter(F.col("consumer_group") == group), now)
    return rows.groupBy("queue").agg(F.sort_array(F.collect_list(F.struct("partition", "lag", "oldest_at", "lag_seconds"))).alias("partitions"))


def lagging_partitions(messages: DataFrame, cursors: DataFrame, now: int, min_seconds: int = 0) -> DataFrame:
    """Lanes whose oldest unread message is older than min_seconds, with hours to two digits."""
    rows = lag(messages, cursors, now).filter(F.col("lag_seconds") > min_seconds)
    return rows.withColumn("lag_hours", F.round(F.col("lag_seconds") / 3600, 2))


# --- statistics -------------------------------------------------------------------------------------


def partition_stats(messages: DataFrame, cursors: DataFrame, dead: DataFrame, now: int) -> DataFrame:
    """Per (lane, group): total, pending, processing, completed, dead, oldest pending and newest message."""
    lanes = messages.groupBy(*LANE).agg(F.count("*").alias("total"), F.max("created_at").alias("newest_at"))
    late = lag(messages, cursors, now)
    held = cursors.select(*LANE, "consumer_group", F.coalesce(F.when(F.col("lease_until") > now, F.greatest(F.col("batch_size") - F.col("acked"), F.lit(0))), F.lit(0)).alias("_held"))
    gone = dead.groupBy(*LANE, "consumer_group").agg(F.count("*").alias("dead"))
    key = [*LANE, "consumer_group"]
    met = late.join(lanes, LANE).join(held, key).join(gone, key, "left")
    processing = F.least("_held", "lag")
    dead_n = F.coalesce("dead", F.lit(0))
    return met.select(*key, "total", (F.col("lag") - processing).alias("pending"), processing.cast("long").alias("processing"), F.greatest(F.col("total") - F.col("lag") - dead_n, F.lit(0)).alias("completed"), dead_n.alias("dead"), F.col("oldest_at"), "newest_at", "lag_seconds")


_MEASURES = ["total", "pending", "processing", "completed", "dead"]


def queue_stats(stats: DataFrame) -> DataFrame:
    """Per queue: the greatest figure over groups of each lane, summed over lanes; mean and greatest lag."""
    lanes = stats.groupBy(*LANE).agg(*[F.max(c).alias(c) for c in _MEASURES], F.max("lag_seconds").alias("lag_seconds"))
    return lanes.groupBy("queue").agg(F.count("*").alias("partitions"), *[F.sum(c).alias(c) for c in _MEASURES], F.avg("lag_seconds").alias("avg_lag"), F.max("lag_seconds").alias("max_lag"))


def rates(now_stats: DataFrame, before: DataFrame, key: str = "queue", total: str = "total", at: str = "at") -> DataFrame:
    """Messages per second between two snapshots (with their times in `at`)."""
    old = before.select(key, F.col(total).alias("_total"), F.col(at).alias("_at"))
    span = (F.col(at) - F.col("_at")) / SECOND
    return now_stats.join(old, key, "left").select(now_stats["*"], F.coalesce(share(F.col(total) - F.col("_total"), span), F.lit(0.0)).alias("rate"))


def hierarchy_stats(queues: DataFrame, level: str) -> DataFrame:
    """Queue figures (with namespace and task) summed up by a level."""
    return queues.groupBy(level).agg(F.count_distinct("queue").alias("queues"), F.sum("partitions").alias("partitions"), *[F.sum(c).alias(c) for c in _MEASURES])


def system_stats(queues: DataFrame) -> DataFrame:
    """One row: all queues' sums and the median of their mean lags."""
    return queues.agg(F.count("*").alias("queues"), F.sum("partitions").alias("partitions"), *[F.sum(c).alias(c) for c in _MEASURES], F.percentile("avg_lag", F.lit(0.5)).alias("median_lag"))


def listing(dimension: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """All rows of a dimension with their figures, zero where there are none."""
    numbers = [c for c in stats.columns if c != key]
    return dimension.join(stats, key, "left").select(*dimension.columns, *[F.coalesce(c, F.lit(0)).alias(c) if c in _MEASURES or c in ("partitions", "queues") else F.col(c) for c in numbers])


def refresh(messages: DataFrame, cursors: DataFrame, dead: DataFrame, queues: DataFrame, now: int) -> dict[str, DataFrame]:
    """All levels at once, each from the one below."""
    lanes = partition_stats(messages, cursors, dead, now)
    per_queue = queue_stats(lanes)
    named = queues.select(F.col("name").alias("queue"), "namespace", "task").join(per_queue, "queue")
    return {"partition": lanes, "queue": per_queue, "namespace": hierarchy_stats(named, "namespace"), "task": hierarchy_stats(named, "task"), "system": system_stats(per_queue)}


def incremental_counts(messages: DataFrame, counted: DataFrame) -> DataFrame:
    """counted (lane, n, upto) brought up to date by the rows after upto (a place); lanes without new rows stay."""
    met = messages.join(counted, LANE, "left").filter(F.col("upto").isNull() | (place() > F.col("upto")))
    new = met.groupBy(*LANE).agg(F.count("*").alias("_new"), F.max(place()).alias("_upto"))
    both = counted.join(new, LANE, "full")
    return both.select(*LANE, (F.coalesce("n", F.lit(0)) + F.coalesce("_new", F.lit(0))).alias("n"), F.coalesce("_upto", "upto").alias("upto"))


# --- time series ------------------------------------------------------------------------------------


def throughput(rows: DataFrame, seconds: int = 60, keys: tuple[str, ...] = (), ts: str = "created_at", n: Column | None = None, lag_ms: Column | None = None) -> DataFrame:
    """Per bucket (and keys): messages, messages per second to two digits, and the mean lag weighted by messages."""
    count = F.lit(1) if n is None else n
    total = F.sum(count)
    out = [total.alias("n"), F.round(total / seconds, 2).alias("per_second")]
    if lag_ms is not None:
        out.append(F.coalesce(share(F.sum(lag_ms * count), total, 2), F.lit(0.0)).alias("avg_lag"))
    return rows.groupBy(floor_to(F.col(ts), seconds).alias("bucket"), *keys).agg(*out)


def samples(rows: DataFrame, seconds: int, keys: list[str], value: str, ts: str = "created_at", order: str = "id") -> DataFrame:
    """Per bucket and keys: number, mean, least, greatest and last value."""
    return rows.groupBy(floor_to(F.col(ts), seconds).alias("bucket"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("avg"), F.min(value).alias("low"), F.max(value).alias("high"), F.max_by(value, F.struct(ts, order)).alias("last"))


def merged_samples(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial samples (n, avg, low, high) of one bucket merged: means weighted by their numbers."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.coalesce(share(F.sum(F.col("avg") * F.col("n")), F.sum("n")), F.lit(0.0)).alias("avg"), F.min("low").alias("low"), F.max("high").alias("high"))


def health(rows: DataFrame, key: str, value: str, ts: str = "created_at") -> DataFrame:
    """Per worker: mean, least and greatest value, and when it was last seen."""
    return rows.groupBy(key).agg(F.avg(value).alias("avg"), F.min(value).alias("low"), F.max(value).alias("high"), F.max(ts).alias("last_seen"))


def totals(rows: DataFrame, counters: list[str]) -> DataFrame:
    """All-time sums of counters."""
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def pivot_counts(rows: DataFrame, seconds: int, column: str, kinds: list[str], ts: str = "created_at") -> DataFrame:
    """Per bucket a count of each kind, and the total."""
    return rows.groupBy(floor_to(F.col(ts), seconds).alias("bucket")).agg(*[F.count(F.when(F.col(column) == k, 1)).alias(k) for k in kinds], F.count("*").alias("total"))


def latest(rows: DataFrame, keys: list[str], since: int, ts: str = "created_at", order: str = "id") -> DataFrame:
    """The newest row of each key from `since` on."""
    cols = [c for c in rows.columns if c not in keys]
    top = rows.filter(F.col(ts) >= since).groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(ts, order)).alias("_r"))
    return top.select(*keys, *[F.col("_r")[c].alias(c) for c in cols])


def status_series(pushes: DataFrame, pops: DataFrame, acks: DataFrame, start: int, end: int, seconds: int | None = None) -> DataFrame:
    """Per bucket of the range: messages pushed, popped and acknowledged (each with n and requests), and messages per request."""
    size = seconds or bucket_seconds(start, end)
    step = size * SECOND
    out = pushes.sparkSession.range(start - start % step, end + 1, step).withColumnRenamed("id", "bucket")
    for name, rows in (("push", pushes), ("pop", pops), ("ack", acks)):
        part = rows.filter(F.col("created_at").between(start, end)).groupBy(floor_to(F.col("created_at"), size).alias("bucket"))
        out = out.join(part.agg(F.sum("n").alias(f"{name}_n"), F.sum("requests").alias(f"_{name}")), "bucket", "left")
    cells = []
    for name in ("push", "pop", "ack"):
        cells += [F.coalesce(f"{name}_n", F.lit(0)).alias(f"{name}_n"), F.coalesce(share(F.col(f"{name}_n"), F.col(f"_{name}"), 2), F.lit(0.0)).alias(f"{name}_batch")]
    return out.select("bucket", *cells)


def overview(messages: DataFrame, cursors: DataFrame, dead: DataFrame, now: int, window: int = 300) -> DataFrame:
    """One row: queues, lanes, messages, pending, dead letters, greatest lag and messages per second of the last minutes."""
    m = messages.agg(F.count_distinct("queue").alias("queues"), F.count_distinct(*LANE).alias("partitions"), F.count("*").alias("messages"), F.round(F.count(F.when(F.col("created_at") >= now - window * SECOND, 1)) / window, 2).alias("per_second"))
    late = lag(messages, cursors, now).agg(F.coalesce(F.sum("lag"), F.lit(0)).alias("pending"), F.coalesce(F.max("lag_seconds"), F.lit(0)).alias("max_lag_seconds"))
    gone = dead.agg(F.count("*").alias("dead"))
    key = F.lit(1).alias("_one")  # three single rows side by side
    return m.select("*", key).join(late.select("*", key), "_one").join(gone.select("*", key), "_one").drop("_one")


def grouped_by_path(rows: DataFrame, path: Column, **aggregates: Column) -> DataFrame:
    """Aggregates by a path into a payload; rows without it are grouped under `null_key`."""
    return rows.groupBy(F.coalesce(path.cast("string"), F.lit("null_key")).alias("key")).agg(*[c.alias(k) for k, c in aggregates.items()])


def percentiles(rows: DataFrame, value: str, keys: list[str], at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Latency percentiles by nearest rank."""
    picks = [F.percentile_approx(value, F.lit(p), F.lit(1_000_000)).alias(f"p{round(p * 100)}") for p in at]
    return rows.groupBy(*keys).agg(*picks)


def queue_lag(rows: DataFrame, start: int, end: int, queue: str | None = None) -> DataFrame:
    """Lag rows (bucket, queue, pop_count, avg_lag_ms, max_lag_ms) of a time range, newest first."""
    out = rows.filter(F.col("bucket").between(start, end))
    return (out if queue is None else out.filter(F.col("queue") == queue)).orderBy(F.desc("bucket"), "queue")


def parked(rows: DataFrame, start: int, end: int, queue: str | None = None) -> DataFrame:
    """Per bucket, queue and replica (hostname, worker_id) the mean number of parked consumers, a missing number counting as none."""
    out = rows.filter(F.col("created_at").between(start, end))
    out = out if queue is None else out.filter(F.col("queue") == queue)
    bucket = floor_to(F.col("created_at"), bucket_seconds(start, end)).alias("bucket")
    return out.groupBy(bucket, "queue", "hostname", "worker_id").agg(F.round(F.avg(F.coalesce("parked", F.lit(0)).cast("double")), 2).alias("parked"))


def lifecycle(created: DataFrame, deleted: DataFrame) -> DataFrame:
    """Lanes created and deleted (queue, at) per minute and queue; those whose queue is gone count as `__orphaned__`."""
    both = created.select("queue", "at", F.lit(1).alias("c"), F.lit(0).alias("d")).union(deleted.select("queue", "at", F.lit(0).alias("c"), F.lit(1).alias("d")))
    return both.groupBy(floor_to(F.col("at"), 60).alias("bucket"), F.coalesce("queue", F.lit("__orphaned__")).alias("queue")).agg(F.sum("c").alias("partitions_created"), F.sum("d").alias("partitions_deleted"))


# --- traces -----------------------------------------------------------------------------------------


def message_traces(traces: DataFrame, message_id) -> DataFrame:
    """A message's trace events with their names, in order of time."""
    return traces.filter(F.col("message_id") == message_id).withColumn("names", F.array_sort("names")).orderBy("created_at", "trace_id")


def traces_by_name(traces: DataFrame, name: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Trace events of a name, oldest first, each with the name's total."""
    rows = traces.filter(F.array_contains("names", name))
    total = rows.agg(F.count("*").alias("total")).select("total", F.lit(1).alias("_one"))
    out = rows.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")
    return out if limit is None else out.orderBy("created_at", "trace_id").offset(offset).limit(limit)


def trace_names(traces: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Per name: events, distinct messages and when it was last seen."""
    each = traces.select(F.explode("names").alias("name"), "trace_id", "message_id", "created_at")
    out = each.groupBy("name").agg(F.count("*").alias("traces"), F.count_distinct("message_id").alias("messages"), F.max("created_at").alias("last_seen"))
    return out if limit is None else out.orderBy(F.desc("last_seen"), "name").offset(offset).limit(limit)


def record_traces(messages: DataFrame, events: DataFrame) -> DataFrame:
    """events (idx, queue, partition, transaction_id, consumer_group, event_type, data, worker, names) with defaults filled in, the message they belong to and `error` (null: recorded). Each name counts once."""
    known = messages.select(*LANE, "transaction_id", F.col("id").alias("message_id"))
    met = events.join(known, [*LANE, "transaction_id"], "left")
    filled = {"consumer_group": F.lit(QUEUE_MODE), "event_type": F.lit("info"), "data": F.lit("{}"), "names": F.array().cast("array<string>")}
    out = met.withColumns({c: F.coalesce(c, default) for c, default in filled.items()}).withColumn("names", F.array_distinct("names"))
    return out.withColumn("error", F.when(F.col("message_id").isNull(), "Message not found"))
