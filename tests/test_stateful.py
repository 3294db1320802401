"""Strict window and gate rules, and streams end to end."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import gates
from sluice.operators.windows import SECOND, Window
from sluice.plans.stream import Stream
from sluice.streaming import commit
from sluice.streaming.run import run, source
from sluice.streaming.stateful import Backlog, Folds, aggregate_step

SCHEMA = "id long, partition string, created_at long, payload struct<amount: int>"


def folds(kind="tumbling", **options):
    return Folds(Window(kind, 60, **options), *aggregate_step({"count": None, "sum": lambda v: v}))


def rows(*at):
    return [(int(t * SECOND), i, "k", v) for i, (t, v) in enumerate(at)]


def test_windows_close_by_the_partitions_clock():
    f = folds()
    state, out, _ = f.batch({}, rows((5, 1), (30, 2), (65, 4)))
    assert [(e[0], e[3]["sum"]) for e in out] == [(0, 3)]
    state, out, _ = f.batch(state, rows((130, 8)))
    assert [(e[0] // SECOND, e[3]["sum"]) for e in out] == [(60, 4)]


def test_lateness_is_judged_by_the_watermark_before_the_batch():
    f = folds(event_time=True, lateness=30)
    state, _, late = f.batch({}, rows((1000, 1), (1, 1)))
    assert late == 0 and state["watermark"] == 970 * SECOND
    state, _, late = f.batch(state, rows((969, 1), (970, 1)))
    assert late == 1
    keep = folds(event_time=True, lateness=30, on_late="include")
    state, _, _ = keep.batch({}, rows((1000, 1)))
    state, out, late = keep.batch(state, rows((5, 7)))
    assert late == 1 and [e[3]["sum"] for e in out] == [7]


def test_sessions_extend_close_and_flush():
    f = folds("session")
    state, out, _ = f.batch({}, rows((0, 1), (60, 2), (121, 4)))
    assert [(e[0], e[1] // SECOND, e[3]["sum"]) for e in out] == [(0, 120, 3)]
    assert f.close(state, 300 * SECOND)[0][3]["sum"] == 4 and state["open"] == {}


def test_aggregate_passes_over_what_is_not_a_number():
    step, acc = aggregate_step({"count": lambda v: v, "min": lambda v: v, "avg": lambda v: v})
    for v in (3, "x", None, 5):
        acc = step(acc, v)
    assert acc["count"] == 10 and acc["min"] == 3 and acc["avg"] == 4


def test_gate_holds_back_what_follows_a_denial():
    b = Backlog(gates.token_bucket(2, 1), lambda v: 1)
    state, out = b.batch({}, rows((0, "a"), (1, "b"), (2, "c"), (3, "d")), 100.0)
    assert [r[3] for r in out] == ["a", "b"] and len(state["waiting"]) == 2
    state, out = b.batch(state, rows((9, "e")), 101.0)
    assert [r[3] for r in out] == ["c"]
    state, out = b.batch(state, [], 110.0)
    assert [r[3] for r in out] == ["d", "e"]


def test_token_bucket_never_exceeds_capacity_and_refill():
    decide, state, passed = gates.token_bucket(5, 2), None, 0
    for i in range(200):
        state, ok = decide(state, 1, i * 0.1)
        passed += ok
        assert passed <= 5 + 2 * i * 0.1 + 1e-9
    assert passed >= 40


@pytest.mark.parametrize("cost", [None, "x", -1, float("nan"), float("inf")])
def test_costs_that_are_no_numbers_count_as_one(cost):
    state, ok = gates.token_bucket(1, 1)(None, cost, 0.0)
    assert ok and state["tokens"] == 0


def test_zero_costs_and_sliding_window():
    assert gates.token_bucket(1, 1)(None, 0, 0.0)[1] and not gates.token_bucket(1, 1, allow_zero_cost=False)(None, 0, 0.0)[1]
    decide, state = gates.sliding_window(4, 10), None
    for _ in range(4):
        state, ok = decide(state, 1, 9.0)
        assert ok
    assert not decide(state, 1, 9.5)[1]
    assert not decide(state, 1, 11.0)[1]  # nine tenths of the four still count
    assert decide(state, 1, 13.0)[1]


def test_batch_gate(spark):
    data = [(i, "a", i * SECOND, (1,)) for i in range(6)]
    out = Stream.from_("q").gate(gates.Gate(gates.token_bucket(2, 0.001))).apply(spark.createDataFrame(data, SCHEMA))
    assert sorted(r.id for r in out.collect()) == [0, 1]


def files(spark, path, *batches):
    for i, b in enumerate(batches):
        spark.createDataFrame([(k, p, int(t * SECOND), (a,)) for k, p, t, a in b], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}")


def test_native_stream_writes_closed_windows_once(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    files(spark, src, [(1, "a", 5, 1), (2, "a", 30, 2), (3, "a", 200, 4)])
    stream = Stream.from_("q").window_tumbling(60).aggregate({"count": None, "sum": lambda v: v["amount"]}).to("sums")
    schema = spark.read.parquet(src).schema
    h = run(stream, source(spark, src, schema), "s1", ckpt, sink=out)
    h.query.awaitTermination(120)
    assert h.state == "new"
    files(spark, src, [(4, "a", 400, 8)])
    h = run(stream, source(spark, src, schema), "s1", ckpt, sink=out)
    h.query.awaitTermination(120)
    assert h.state == "resumed"
    got = sorted(r.payload for r in commit.read_sink(spark, out).collect())
    assert got == ['{"count":1,"sum":4}', '{"count":2,"sum":3}']


def test_changed_structure_is_refused_unless_reset(spark, tmp_path):
    c = str(tmp_path / "c")
    assert commit.register(spark, c, "q", "h1") == "new"
    assert commit.register(spark, c, "q", "h1") == "resumed"
    with pytest.raises(commit.ConfigChanged):
        commit.register(spark, c, "q", "h2")
    assert commit.register(spark, c, "q", "h2", reset=True) == "reset"


def test_strict_stream_over_two_batches(spark, tmp_path, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", before))
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    files(spark, src, [(1, "a", 1000, 1), (2, "b", 10, 2)])
    schema = spark.read.parquet(src).schema
    plan = Stream.from_("q").map(lambda m: m["payload"]["amount"]).window_tumbling(60, event_time=lambda m: m["created_at"], allowed_lateness=30).aggregate({"sum": lambda v: v})
    run(plan, source(spark, src, schema), "s", ckpt, sink=out, strict=True).query.awaitTermination(180)
    files(spark, src, [(3, "a", 900, 100), (4, "a", 1100, 4), (5, "b", 20, 8)])
    run(plan, source(spark, src, schema), "s", ckpt, sink=out, strict=True).query.awaitTermination(180)
    got = [(r.partition, r.window_start // SECOND, r.value) for r in commit.read_sink(spark, out).collect()]
    # a's late row is dropped by a's own watermark; b's clock is far behind, so b's window stays open
    assert got == [("a", 960, '{"sum": 1}')]


def test_versions_of_a_table_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    add = commit.fold_table(spark, path, lambda now, batch: batch if now is None else now.union(batch))
    one = spark.range(2)
    add(one, 0)
    add(one, 1)
    add(one, 1)  # run again after a failure
    assert commit.newest(spark, path).count() == 4
    assert commit.newest(spark, path).agg(F.max("id")).first()[0] == 1
