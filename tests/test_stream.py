"""Pipeline rules, windows and reducers."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import windows
from sluice.operators.windows import SECOND
from sluice.plans.stream import PlanError, Stream, context, emits


def log(spark, rows):
    """rows: (id, partition, seconds, amount)"""
    return spark.createDataFrame([(i, p, int(t * SECOND), (a,)) for i, p, t, a in rows], "id long, partition string, created_at long, payload struct<amount: int>")


S = Stream.from_("q")
SUM = {"count": None, "sum": lambda v: v["amount"]}


@pytest.mark.parametrize(
    "chain",
    [
        lambda: S.reduce(lambda a, v: a, F.lit(0)),
        lambda: S.window_tumbling(1).window_tumbling(1),
        lambda: S.to("x").map(lambda m: m),
        lambda: S.key_by(lambda m: m["id"]).key_by(lambda m: m["id"]),
        lambda: S.window_tumbling(1).aggregate(SUM).key_by(lambda m: m["id"]),
        lambda: S.window_tumbling(1).aggregate(SUM).aggregate(SUM),
        lambda: S.window_tumbling(1).aggregate(SUM).window_tumbling(1),
        lambda: S.window_tumbling(1).gate(None),
        lambda: S.gate(None).gate(None),
        lambda: S.gate(None).window_tumbling(1),
        lambda: S.window_session(5),
    ],
)
def test_broken_rules(spark, chain):
    with pytest.raises(PlanError):
        chain().compile()


@pytest.mark.parametrize("make", [lambda: S.window_sliding(10, 3), lambda: S.window_tumbling(0), lambda: S.window_tumbling(5, on_late="keep"), lambda: S.window_cron("month")])
def test_bad_windows(make):
    with pytest.raises(ValueError):
        make()


def test_chain_is_immutable_and_hash_is_structural():
    a = S.map(lambda m: m)
    b = S.map(lambda m: m["id"])
    assert S.steps == () and a.config_hash() == b.config_hash()
    assert a.config_hash() != S.filter(lambda m: True).config_hash()
    assert S.window_tumbling(60).config_hash() != S.window_tumbling(61).config_hash()


def test_pre_operators_read_the_message_and_post_ones_compose(spark):
    rows = log(spark, [(1, "a", 0, 5), (2, "a", 1, 50)])
    out = S.map(lambda m: m["id"] * 0).map(lambda m: m["payload"]["amount"] + 1).filter(lambda m: m["payload"]["amount"] > 10).apply(rows)
    assert [r.value for r in out.collect()] == [51]
    post = S.window_tumbling(60).aggregate(SUM).map(lambda v: v["sum"]).map(lambda v: v * 2)
    assert [r.value for r in post.apply(rows).collect()] == [110]


def test_null_values_stay_null(spark):
    out = S.map(lambda m: F.lit(None).cast("int")).apply(log(spark, [(1, "a", 0, 5)]))
    assert out.first().value is None


def test_opaque_callables(spark):
    rows = log(spark, [(1, "a", 0, 5), (2, "a", 1, 6)])
    out = S.map(lambda m: m["id"] * 10, returns="long").filter(lambda m: m["id"] > 1, opaque=True).apply(rows)
    assert [r.value for r in out.collect()] == [20]


def test_sliding_copies_and_calendar_weeks(spark):
    one = log(spark, [(1, "a", 65, 5)])
    starts = sorted(r.window_start // SECOND for r in S.window_sliding(60, 10).windowed(one).collect())
    assert starts == [10, 20, 30, 40, 50, 60]
    monday = 4 * 86400  # 1970-01-05
    rows = log(spark, [(1, "a", monday - 1, 1), (2, "a", monday, 1), (3, "a", monday + 7 * 86400 - 1, 1)])
    weeks = {r.id: r.window_start // SECOND for r in S.window_cron("week").windowed(rows).collect()}
    assert weeks == {1: monday - 7 * 86400, 2: monday, 3: monday}


def test_session_gap_is_inclusive(spark):
    rows = log(spark, [(1, "a", 0, 1), (2, "a", 30, 2), (3, "a", 60.000001, 4), (4, "b", 10, 8)])
    out = S.window_session(30).aggregate(SUM).apply(rows)
    assert sorted((r.partition, r.window_start, r.value.sum) for r in out.collect()) == [("a", 0, 3), ("a", 60000001, 4), ("b", 10 * SECOND, 8)]


def test_close_and_grace(spark):
    rows = log(spark, [(1, "a", 5, 1), (2, "a", 30, 2), (3, "a", 65, 4)])
    closed = lambda s: [r.value.sum for r in s.aggregate(SUM).apply(rows, closed_only=True).collect()]
    assert closed(S.window_tumbling(60)) == [3]
    assert closed(S.window_tumbling(60, grace_period=6)) == []


def test_late_rows_against_the_clock_before(spark):
    w = windows.Window("tumbling", 60, lateness=30, event_time=lambda m: m["created_at"])
    first = log(spark, [(1, "a", 1000, 1), (2, "b", 10, 1)]).withColumnRenamed("created_at", "ts")
    second = log(spark, [(3, "a", 960, 1), (4, "a", 975, 1), (5, "b", 5, 1), (6, "c", 1, 1)]).withColumnRenamed("created_at", "ts")
    late = windows.late(second, windows.clocks(first, w))
    assert {r.id for r in late.filter("is_late").collect()} == {3}


def test_event_time_that_cannot_be_read_is_an_error_row(spark):
    rows = log(spark, [(1, "a", 1, 5), (2, "a", 2, None)])
    plan = S.window_tumbling(60, event_time=lambda m: m["payload"]["amount"] * SECOND).aggregate(SUM)
    assert [r.id for r in plan.errors(rows).collect()] == [2]
    assert plan.apply(rows).count() == 1


def test_sink_rows(spark):
    rows = S.map(lambda m: m["payload"]["amount"]).apply(log(spark, [(1, "a", 0, 5), (2, None, 0, 6)]))
    out = emits(rows, S.to("out").compile().sink).collect()
    assert {(r.queue, r.partition, r.payload) for r in out} == {("out", "a", '{"value":5}'), ("out", "Default", '{"value":6}')}
    ctx = S.window_tumbling(60).aggregate(SUM).apply(log(spark, [(1, "a", 61.5, 5)]))
    assert ctx.select(context(ctx)["windowKey"]).first()[0] == "1970-01-01T00:01:00.000Z"


def test_native_streams_refuse_late_rows_they_would_drop(spark):
    import pytest

    from sluice.plans.stream import PlanError, Stream
    from sluice.streaming.run import native

    rows = spark.createDataFrame([], "id long, transaction_id string, queue string, partition string, created_at long, payload struct<v:int>")
    plan = Stream.from_("q").window_tumbling(60, on_late="include", event_time=lambda m: m["created_at"]).aggregate({"n": None})
    with pytest.raises(PlanError):
        native(plan, rows)
