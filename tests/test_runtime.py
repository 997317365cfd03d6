"""The handler surface: the stack around a user's handler, key by key, as a table and as a stream."""

import pytest
from pyspark.sql import functions as F

from keystrand.operators import decode, defer, runtime
from keystrand.operators.runtime import Context, InvalidContext, KeyHandler, KeyRunner, KeyState, Message, PermanentError, Policy, TerminalError
from keystrand.sources.log import event_log

SF = "/root/testdata/sf0.001"


class Scripted(KeyHandler):
    """Calls of an event do in turn what its script says: raise, run a function of the context, or nothing."""

    def __init__(self, **script):
        self.script, self.calls, self.hooks, self.contexts = {k: list(v) for k, v in script.items()}, [], [], []

    def _do(self, name, context):
        self.calls.append((name, context.demand))
        self.contexts.append(context)
        todo = self.script.get(name) or [None]
        step = todo.pop(0) if len(todo) > 1 else todo[0]
        if isinstance(step, type):
            raise step()
        if step is not None:
            step(context)

    def on_message(self, context, message):
        self._do(f"m{message.off}", context)

    def on_timer(self, context, timer):
        self._do(f"t{timer.time_s}", context)

    def after_commit(self, event, category):
        self.hooks.append((event[0], "commit", category))

    def after_abort(self, event, category):
        self.hooks.append((event[0], "abort", category))


def runner_of(policy=None, **script):
    return KeyRunner(Scripted(**script), policy or Policy())


def msg(off, at_s, id_=None):
    return Message(off, at_s * 1000, id_, None)


def actions(runner):
    return [(kind, id_, at // 1000, action) for kind, id_, at, _, _, action in runner.rows]


def test_deferred_queue_drains_in_order():
    r = runner_of(m0=[OSError, OSError, OSError, None], m1=[None])
    r.message(msg(0, 10))
    r.message(msg(1, 11))
    r.advance(100_000)
    # tries at 10 (at once), 11 (a second later), 13 (two more); message 1 waits behind
    assert actions(r) == [("message", 0, 10, "deferred"), ("message", 0, 10, "deferred"), ("message", 0, 11, "deferred"), ("message", 1, 11, "queued"), ("message", 0, 13, "done"), ("message", 1, 13, "done")]
    assert r.handler.hooks[-2:] == [(0, "commit", "success"), (1, "commit", "success")] and {h[1] for h in r.handler.hooks[:-2]} == {"abort"}
    assert r.state.idle() and not r.state.messages.items
    r.message(msg(2, 200))
    assert actions(r)[-1] == ("message", 2, 200, "done")


def test_permanent_failure_of_a_head_advances():
    r = runner_of(m0=[OSError, PermanentError], m1=[None])
    r.message(msg(0, 10))
    r.advance(10_000)
    assert [row[4:] for row in r.rows] == [(None, "deferred"), ("permanent", "done")]


def test_deduplication_comes_before_the_handler():
    r = runner_of(m0=[PermanentError], m5=[OSError])
    r.message(msg(0, 10, "a"))
    r.message(msg(1, 11, "a"))
    r.message(msg(2, 12, None))
    r.message(msg(3, 10 + 7 * 86_400, "a"))  # forgotten by then
    assert [c[0] for c in r.handler.calls] == ["m0", "m2", "m3"]
    assert [row[5] for row in r.rows] == ["done", "duplicate", "done", "done"]
    off = runner_of(Policy(dedup_ttl_s=0))
    off.message(msg(0, 1, "a"))
    off.message(msg(1, 2, "a"))
    assert len(off.handler.calls) == 2


def test_without_deferral_a_key_is_retried_and_holds_up_the_rest():
    r = runner_of(Policy(defers=False, retry_base_ms=500), m0=[OSError, OSError, None])
    r.message(msg(0, 10))
    r.message(msg(1, 10))
    assert [row[5] for row in r.rows] == ["retried", "waiting"]
    r.advance(60_000)
    assert [(row[1], row[2], row[3], row[5]) for row in r.rows[2:]] == [(0, 11_000, "failure", "retried"), (0, 13_000, "failure", "done"), (1, 13_000, "normal", "done")]
    assert not r.state.blocked and r.handler.hooks == [(0, "abort", "transient"), (0, "abort", "transient"), (0, "commit", "success"), (1, "commit", "success")]


def test_timers_fire_and_are_deferred():
    r = runner_of(m0=[lambda c: (c.schedule(20), c.schedule(30), c.schedule(30))], t20=[OSError, OSError, None])
    r.message(msg(0, 10))
    r.advance(19_999)
    assert actions(r) == [("timer", 20, 10, "scheduled"), ("timer", 30, 10, "scheduled"), ("timer", 30, 10, "scheduled"), ("message", 0, 10, "done")]
    r.advance(100_000)
    assert actions(r)[4:] == [("timer", 20, 20, "deferred"), ("timer", 20, 20, "deferred"), ("timer", 20, 21, "done"), ("timer", 30, 30, "done")]
    assert r.state.idle()


def test_timers_behind_a_deferred_one_are_queued_under_their_time():
    seen = []
    r = runner_of(Policy(defer_base_s=3600), m0=[lambda c: (c.schedule(20), c.schedule(30))], t20=[OSError, OSError, None], m1=[lambda c: (c.schedule(25), seen.append(c.scheduled()))], m2=[lambda c: (c.unschedule(30), seen.append(c.scheduled()))])
    r.message(msg(0, 10))
    r.message(msg(1, 40))  # messages aren't deferred by timers
    assert seen == [[20, 25, 30]] and r.state.timers == [20, 25, 30]
    r.message(msg(2, 41))
    assert seen[1] == [20, 25]
    r.advance(10_000_000)
    assert actions(r)[-2:] == [("timer", 20, 3620, "done"), ("timer", 25, 3620, "done")]


def test_clear_and_schedule_drops_the_queue():
    r = runner_of(Policy(defer_base_s=3600), m0=[lambda c: c.schedule(20)], t20=[OSError], m1=[lambda c: c.clear_and_schedule(500)])
    r.message(msg(0, 10))
    r.message(msg(1, 40))
    assert not r.state.timers and r.state.times == {500: "scheduled"}
    r.advance(10_000_000)
    assert actions(r)[-1] == ("timer", 500, 500, "done") and len([c for c in r.handler.calls if c[0] == "t20"]) == 2


def test_a_firing_timer_that_sets_its_time_again_fires_again():
    r = runner_of(m0=[lambda c: c.schedule(20)], t20=[lambda c: c.schedule(20), None])
    r.message(msg(0, 10))
    r.advance(50_000)
    assert [c[0] for c in r.handler.calls] == ["m0", "t20", "t20"]


def test_context_ends_with_its_event():
    r = runner_of()
    r.message(msg(0, 10))
    context: Context = r.handler.contexts[0]
    for use in (lambda: context.schedule(99), lambda: context.unschedule(99), lambda: context.clear(), lambda: context.clear_and_schedule(99), context.scheduled, context.cancel):
        with pytest.raises(InvalidContext):
            use()
    assert InvalidContext.category == "permanent"


def test_cancelled_events_fail_transiently():
    r = runner_of(m0=[lambda c: (c.cancel(), c.schedule(99)), None])
    r.message(msg(0, 10))
    r.advance(20_000)
    assert [row[5] for row in r.rows] == ["deferred", "done"] and not r.state.times


def test_terminal_errors_abort():
    r = runner_of(m0=[TerminalError])
    r.message(msg(0, 10, "a"))
    assert r.rows[-1][4:] == ("terminal", "aborted") and r.handler.hooks == [(0, "abort", "terminal")] and not r.state.seen


def test_gate_refuses_a_key_that_runs_too_long():
    def long(context):
        context.elapsed_ms = 280_000

    r = runner_of(Policy(gate_share=0.9), m0=[long])
    r.message(msg(0, 0))
    r.message(msg(1, 280))
    assert [row[5] for row in r.rows] == ["done", "deferred"]
    assert [c[0] for c in r.handler.calls] == ["m0"] and [h[0] for h in r.handler.hooks] == [0]
    r.advance(700_000)
    assert [c[0] for c in r.handler.calls] == ["m0", "m1"]


def test_state_survives_its_text():
    r = runner_of(Policy(defer_base_s=3600), m0=[lambda c: c.schedule(20)], m1=[OSError], t20=[OSError])
    for m in (msg(0, 10), msg(1, 30), msg(2, 31)):
        r.message(m)
    s = r.state
    again = KeyState.loads(s.dumps(), s.messages.items, s.blocked.items, s.seen)
    assert again == s and len(again.messages) == 2 and again.timers == [20]


class Failing(KeyHandler):
    """Fails on arrival if the payload's number isn't 0, then once less than that from the queue."""

    def __init__(self):
        self.tries = {}

    def on_message(self, context, message):
        n = int(message.payload)
        if n and context.demand == "normal":
            raise OSError
        self.tries[message.off] = self.tries.get(message.off, 0) + 1
        if self.tries[message.off] < n:
            raise OSError


def _failing_log(spark):
    n = F.when(F.col("outcome") == "transient", F.col("event_id") % 4 + 1).otherwise(0)
    return event_log(spark, SF).select("topic", "part", "key", "off", "ts_us", F.lit(None).cast("string").alias("id"), n.cast("string").alias("payload"), "outcome", (n - 1).alias("fails"))


def test_run_agrees_with_the_replay_of_deferral(spark):
    log = _failing_log(spark)
    events = log.select("topic", "part", "key", "off", F.col("off").alias("ord"), F.floor(F.col("ts_us") / 1000).alias("at_s"), "outcome", F.greatest("fails", F.lit(0)).alias("fails"))
    want = {(r["part"], r["off"]): r["action"] for r in defer.replay(events.withColumn("at_s", F.floor(F.col("at_s") / 1000)), base_s=3600).collect()}
    whole = log.withColumn("ts_us", F.floor(F.col("ts_us") / 1_000_000) * 1_000_000)
    rows = runtime.run(whole, Failing, Policy(defer_base_s=3600, dedup_ttl_s=0)).where("demand IS NULL OR demand = 'normal'")
    got = {(r["part"], r["id"]): {"done": "handled"}.get(r["action"], r["action"]) for r in rows.collect()}
    wrong = {k: (want[k], got[k]) for k in want if want[k] != got[k]}
    assert set(got) == set(want) and not wrong


def test_handler_stream(spark, tmp_path):
    from keystrand.streaming.processors import handler_stream
    from tests.test_streaming import until

    log = decode.identify(event_log(spark, SF)).withColumn("payload", F.when(F.col("event_id") % 25 == 0, "1").otherwise("0"))
    rows = log.select("topic", "part", "key", "off", "ts_us", "id", "payload")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = handler_stream(stream, Failing, Policy(defer_base_s=1)).writeStream.format("memory").queryName("handler_out").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    n = rows.count()
    ended = lambda: spark.table("handler_out").where("action IN ('done', 'duplicate')").count()
    until(lambda: ended() >= n, query)
    found = spark.table("handler_out")
    assert ended() == n and found.where("action = 'deferred'").count() > 0
    assert found.where("action IN ('done', 'duplicate')").select("part", "id").distinct().count() == n


class FailsThrice(KeyHandler):
    """The first three tries of messages whose payload is x fail."""

    def __init__(self):
        self.tries = {}

    def on_message(self, context, message):
        self.tries[message.off] = self.tries.get(message.off, 0) + 1
        if message.payload == "x" and self.tries[message.off] <= 3:
            raise OSError


def test_run_folds_keys_in_one_pass(spark):
    """Keys that end within a batch and keys over many batches: the same as each key by itself, and no group is made for a key."""
    rows = [("t", k % 2 or None, f"k{k}", off, (off * 7 + k) * 300_000, f"i{off % 5}" if off % 3 else None, "x" if (off + k) % 4 == 0 else None) for k in range(12) for off in range(k * k)]
    log = spark.createDataFrame(rows, "topic string, part int, key string, off bigint, ts_us bigint, id string, payload string").repartition(5)
    policy, want = Policy(dedup_ttl_s=60), []
    for k in range(1, 12):
        runner = KeyRunner(FailsThrice(), policy)
        for _, _, _, off, us, id_, payload in (r for r in rows if r[2] == f"k{k}"):
            runner.message(Message(off, us // 1000, id_, payload))
        runner.advance(10**9)
        want += [("t", k % 2 or None, f"k{k}", *r) for r in runner.rows]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = runtime.run(log, FailsThrice, policy, 10**9)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r[-1] for r in want} >= {"done", "duplicate", "deferred", "queued"}
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_forgetting_looks_only_at_what_has_ended():
    """An identity that is recorded again ends behind those of the meantime."""
    r = runner_of(Policy(dedup_ttl_s=10))
    for off, at_s, id_ in [(0, 0, "a"), (1, 5, "b"), (2, 11, "a"), (3, 12, "c")]:
        r.message(msg(off, at_s, id_))
    assert list(r.state.seen) == ["ib", "ia", "ic"]
    looked = []
    items = r.state.seen.items
    r.state.seen = type("Counted", (type(r.state.seen),), {"__delitem__": lambda d, k: (looked.append(k), super(type(d), d).__delitem__(k))})(items())
    r.forget(20_000)
    assert looked == ["ib"] and list(r.state.seen) == ["ia", "ic"]
