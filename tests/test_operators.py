"""Boundary cases and reference models."""

import random
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from keystrand.config import ConsumerSettings, DeferSettings, StorageSettings, duration
from keystrand.functions import scalars as fn
from keystrand.operators import decode, dedup, defer, filters, offsets, timers, windows
from keystrand.plans.modes import Engine, State


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("micros", "seconds"), [(1_499_999, 1), (1_500_000, 2), (0, 0), (-600_000, None), ((2**32) * 1_000_000, None)])
def test_compact_seconds(spark, micros, seconds):
    assert one(spark, fn.compact_seconds(F.lit(micros))) == seconds


def test_slab_of_size_zero(spark):
    assert one(spark, fn.slab_of(F.lit(5_000), 0)) == 0
    assert one(spark, fn.slab_of(F.lit(7_199), 3600)) == 1


@pytest.mark.parametrize("name", ["group:topic/0", "äöü:x/11", ""])
def test_uuid5(spark, name):
    assert one(spark, fn.uuid5(fn.NAMESPACE_URL, F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert one(spark, fn.uuid5(fn.NAMESPACE_OID, F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_OID, name))


@pytest.mark.parametrize(("payload", "id_"), [('{"id":"a"}', "a"), ('{"id":5}', None), ('{"id":null}', None), ("{}", None), ("[1]", None), ("null", None), ('"x"', None)])
def test_only_string_ids(spark, payload, id_):
    row = decode.identify(spark.createDataFrame([(payload,)], "payload string")).first()
    assert row["id"] == id_


@pytest.mark.parametrize(("key", "payload", "reason"), [(None, "{}", "no_key"), ("k", None, "no_payload"), ("k", "{", "bad_payload"), ("k", "1", None), ("k", "null", None)])
def test_rejects(spark, key, payload, reason):
    df = spark.createDataFrame([(key, payload)], "key string, payload string")
    assert df.select(decode.reject_reason(F.col("key"), F.col("payload")).alias("r")).first()["r"] == reason


def test_bad_utf8_key(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xfe"), "{}")], "k binary, payload string")
    assert df.select(decode.reject_reason(F.col("k").cast("string"), F.col("payload")).alias("r")).first()["r"] == "bad_key"


def test_event_type_filter_passes_without_type_or_prefixes(spark):
    assert one(spark, filters.is_unwanted_type(F.lit(None).cast("string"), ["a"])) is False
    assert one(spark, filters.is_unwanted_type(F.lit("zz"), [])) is False
    assert one(spark, filters.is_unwanted_type(F.lit("xa"), ["a"])) is True


def test_commit_watermark_against_model(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for part in range(20):
        offs = sorted(rng.sample(range(60), rng.randint(1, 25)))
        done = [rng.random() < 0.8 for _ in offs]
        rows += [("t", part, o, d) for o, d in zip(offs, done, strict=True)]
        prefix = [o for i, o in enumerate(offs) if all(done[: i + 1])]
        want[part] = prefix[-1] if prefix else None
    df = spark.createDataFrame(rows, "topic string, part int, off bigint, done boolean")
    assert {r["part"]: r["watermark"] for r in offsets.commit_watermark(df, F.col("done")).collect()} == want


def test_monopolization_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for key in range(12):
        t = 0
        for off in range(25):
            t += rng.choice([0, 1, 50, 400])
            end = t + rng.choice([1, 80, 900, 5000])
            rows.append(("t", 0, str(key), off, t, end))
            t = end
    df = spark.createDataFrame(rows, "topic string, part int, key string, off bigint, start_ms bigint, end_ms bigint")
    got = {(r["key"], r["off"]): r["busy_ms"] for r in windows.monopolization(df, 1000).collect()}
    for _, _, key, off, t, _ in rows:
        busy = sum(max(0, min(e, t) - max(s, t - 1000)) for _, _, k, _, s, e in rows if k == key and s < t)
        assert got[key, off] == busy


@pytest.mark.parametrize(("busy", "rejected"), [(900, False), (901, True)])
def test_monopolization_threshold_is_exclusive(spark, busy, rejected):
    df = spark.createDataFrame([("t", 0, "k", 0, 1000 - busy, 1000), ("t", 0, "k", 1, 1000, 1001)], "topic string, part int, key string, off bigint, start_ms bigint, end_ms bigint")
    assert windows.monopolization(df, 1000).where("off = 1").first()["rejected"] is rejected


def test_rate_at_threshold_does_not_defer(spark):
    assert one(spark, windows.defers(F.lit(0.9), 0.9)) is False


def test_class_share_converges():
    """Picking by weighted time gives the failure class its share."""
    spent = {"normal": 0.0, "failure": 0.0}
    for _ in range(1000):
        spent["normal" if spent["normal"] / 0.7 <= spent["failure"] / 0.3 else "failure"] += 0.1
    assert abs(spent["failure"] / sum(spent.values()) - 0.3) < 0.02


def test_timer_commands_while_firing():
    times = {60: "firing"}
    assert timers.apply_command(times, "unschedule", 60) == [] and times == {60: "firing"}
    timers.apply_command(times, "schedule", 60)
    assert times == {60: "firing_rescheduled"}
    timers.apply_command(times, "complete", 60)
    assert times == {60: "scheduled"}
    timers.apply_command(times, "fire", 60)
    timers.apply_command(times, "abort", 60)
    assert times == {60: "stored"}
    timers.apply_command(times, "fire", 60)
    assert times == {60: "stored"}
    timers.apply_command(times, "reload", 60)
    timers.apply_command(times, "schedule", 70)
    assert times == {60: "scheduled", 70: "scheduled"}
    assert timers.apply_command(times, "clear_and_schedule", 90) == ["cancelled", "cancelled", "scheduled"] and times == {90: "scheduled"}
    assert timers.apply_command(times, "clear_and_schedule", 90) == ["scheduled"] and times == {90: "scheduled"}


def test_timer_replay_against_sets(spark):
    rng = random.Random(9)
    rows, want = [], defaultdict(set)
    for ord_ in range(400):
        key, op, t = f"k{rng.randint(0, 4)}", rng.choice(["schedule", "schedule", "unschedule", "clear", "clear_and_schedule"]), rng.randint(0, 9) * 60
        rows.append((0, key, 0, ord_, op, t))
        if op == "schedule":
            want[key].add(t)
        elif op == "unschedule":
            want[key].discard(t)
        else:
            want[key] = set() if op == "clear" else {t}
    df = spark.createDataFrame(rows, "part int, key string, timer_type int, ord bigint, op string, time_s bigint")
    for replayed in (timers.replay(df), timers.scheduled_after(df)):
        got = defaultdict(set)
        for r in replayed.collect():
            got[r["key"]].add(r["time_s"])
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def queue_by_force(rows, base_s):
    """Per key a list of waiting messages whose head is tried by its timer, second by second of events."""
    done, actions, queue, due, tries = {}, {}, [], None, 0

    def fire(until):
        nonlocal due, tries
        while queue and due <= until:
            off, fails = queue[0]
            if tries < fails:
                tries += 1
                due += defer.bound_s(tries, base_s)
            else:
                done[off] = due
                queue.pop(0)
                tries = 0

    for off, at, outcome, fails in rows:
        fire(at)
        if queue:
            queue.append((off, fails))
            actions[off] = "queued"
        elif outcome == "transient":
            queue.append((off, fails))
            due, tries, actions[off] = at, 0, "deferred"
        else:
            actions[off] = "handled"
    fire(10**9)
    return {off: (a, done.get(off)) for off, a in actions.items()}


def test_defer_replay_against_a_queue(spark):
    rng = random.Random(17)
    rows, want = [], {}
    for k in range(20):
        at, own = 0, []
        for off in range(30):
            at += rng.choice([1, 1, 2, 9, 40])
            own.append((off, at, rng.choice(["success", "permanent", "transient"]), rng.randint(0, 4)))
        rows += [("t", 0, f"k{k}", off, off, at, o, f) for off, at, o, f in own]
        want |= {(f"k{k}", off): x for off, x in queue_by_force(own, 2).items()}
    df = spark.createDataFrame(rows, "topic string, part int, key string, ord bigint, off bigint, at_s bigint, outcome string, fails int")
    replayed = defer.replay(df, base_s=2)
    got = {(r["key"], r["off"]): (r["action"], r["done_s"]) for r in replayed.collect()}
    assert got == want and len({a for a, _ in got.values()}) == 3
    last = {(r["key"], r["off"]): r["at_s"] for r in defer.retries(replayed, base_s=2).where("NOT failed").collect()}
    assert last == {k: d for k, (a, d) in got.items() if a != "handled"}
    never = defer.replay(df.withColumn("defers", F.lit(False)))
    assert {r["action"] for r in never.collect()} == {"handled", "failed"} and never.where("done_s IS NOT NULL").count() == 0


def test_failure_records_suit_the_writer(spark):
    from keystrand.sources import sinks

    df = spark.createDataFrame([("t", 0, 5, "k", "{}", "message", "permanent", "boom", 1_000_000)], "topic string, part int, off bigint, key string, payload string, kind string, category string, error string, ts_us bigint")
    out = sinks.failure_records(df, "g", "dead")
    assert out.dtypes == [("topic", "string"), ("key", "binary"), ("value", "binary"), ("headers", "array<struct<key:string,value:binary>>")]


def test_slab_table_prunes(spark, tmp_path):
    df = spark.createDataFrame([(0, "k", 0, 60 * i) for i in range(100)], "part int, key string, timer_type int, time_s bigint")
    timers.write_slabs(df, str(tmp_path / "slabs"), 600)
    scan = timers.slab_scan(spark.read.parquet(str(tmp_path / "slabs")), 2, 3)
    assert scan.count() == 20 and len(scan.inputFiles()) == 10
    assert "PartitionFilters: [isnotnull(slab_id" in scan._jdf.queryExecution().toString()


def test_empty_log(spark):
    df = spark.createDataFrame([], "topic string, part int, off bigint, done boolean")
    assert offsets.commit_watermark(df, F.col("done")).count() == 0


def test_settings():
    assert duration("1h 30m") == 5400 and duration("none") is None and duration("100ms") == 0.1
    with pytest.raises(ValueError):
        duration("soon")
    s = ConsumerSettings.from_env("X_", {"X_GROUP_ID": "g", "X_SUBSCRIBED_TOPICS": "a, b,", "X_SLAB_SIZE": "10m"})
    assert s.source == "g" and s.topics == ["a", "b"] and s.slab_size_s == 600
    with pytest.raises(ValueError):
        DeferSettings(base_s=10, max_s=5)
    with pytest.raises(ValueError):
        StorageSettings(retention_s=1e9)
    assert Engine(None, ConsumerSettings()).state is State.CONFIGURATION_FAILED


def test_mode_settings_validate_what_the_mode_needs():
    from keystrand.config import FailureTopicSettings, ModeSettings

    env = {"K_GROUP_ID": "g", "K_SUBSCRIBED_TOPICS": "a, b", "K_FAILURE_TOPIC": "failed", "K_KEYSPACE": "ks", "K_DEFER_BASE": "2s"}
    low = ModeSettings.from_env("low-latency", prefix="K_", env=env)
    assert low.topics() == ["a", "b", "failed"] and "defer" not in low.parts and low.store_path("/t", "timers") == "/t/ks/timers"
    pipe = ModeSettings.from_env("pipeline", mock=True, prefix="K_", env=env)
    assert pipe.topics() == ["a", "b"] and pipe.parts["defer"].base_s == 2 and pipe.storage is None and pipe.store_path("/t", "timers") is None
    assert set(ModeSettings.from_env("best-effort", prefix="K_", env=env).parts) == {"scheduler"}
    for mode, bad in (("low-latency", {"K_GROUP_ID": "g"}), ("pipeline", {}), ("pipeline", {"K_GROUP_ID": "g", "K_DEDUP_TTL": "1s"}), ("other", env)):
        with pytest.raises(ValueError):
            ModeSettings.from_env(mode, prefix="K_", env=bad)
    assert ModeSettings.from_env("best-effort", prefix="K_", env={"K_GROUP_ID": "g", "K_DEDUP_TTL": "1s"})  # not a setting of this mode
    with pytest.raises(ValueError):
        FailureTopicSettings()


def test_policy_of_settings():
    from keystrand.config import DedupSettings, MonopolizationSettings, RetrySettings
    from keystrand.plans.modes import policy_of

    policy = policy_of(RetrySettings(), DeferSettings(enabled=False), MonopolizationSettings(enabled=False), DedupSettings(cache_size=0))
    assert (policy.dedup_ttl_s, policy.defers, policy.gate_share, policy.retry_base_ms, policy.retry_max_ms) == (0, False, None, 20, 300_000)
    assert policy_of(RetrySettings(), DeferSettings(), MonopolizationSettings(), DedupSettings()).gate_share == 0.9


def test_producers_wait_by_mode():
    from keystrand.sources.sinks import producer_options

    assert producer_options("h:1")["kafka.delivery.timeout.ms"] == "2147483647"
    assert producer_options("h:1", "low-latency")["kafka.delivery.timeout.ms"] == "1000" == producer_options("h:1", "best-effort")["kafka.request.timeout.ms"]


def test_a_silent_query_is_stalled():
    from datetime import UTC, datetime, timedelta

    class Query:
        lastProgress = {"timestamp": "2024-01-01T00:00:00.000Z", "batchDuration": 500}

    engine = Engine(None, ConsumerSettings(group_id="g", stall_threshold_s=60))
    assert not engine.stalled() and engine.live()
    engine.query, engine._heard = Query(), datetime(2024, 1, 1, tzinfo=UTC)
    assert not engine.stalled(datetime(2024, 1, 1, 0, 1, tzinfo=UTC))
    assert engine.stalled(datetime(2024, 1, 1, 0, 1, 1, tzinfo=UTC))
    Query.lastProgress = None
    engine._heard = datetime.now(UTC) - timedelta(seconds=30)
    assert not engine.stalled()


@pytest.mark.parametrize(("codec", "payload", "want"), [("json", '{"b": 1, "a": [ ]}', b'{"a":[],"b":1}'), ("json", "{", None), ("json", None, None), ("binary", "{", b"{"), ("json_binary", "x", b"x")])
def test_encode(spark, codec, payload, want):
    found = one(spark, decode.encode(F.lit(payload).cast("string"), codec))
    assert (None if found is None else bytes(found)) == want
    with pytest.raises(ValueError):
        decode.encode(F.lit("x"), "xml")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_failure_rate_slides_in_spans(spark):
    """Against brute force, negative times and a missing one included; no single task sees all seconds."""
    times = [-1, 0, 0, 1, 9, 10, 11, 12, 21, 22, 32, 33, 34, 500, 511, 512, 1_000_000]
    log = [(t * 1_000_000 + 5, "success" if i % 3 else "transient") for i, t in enumerate(times)]
    rows = spark.createDataFrame([*log, (None, "transient")], "ts_us long, outcome string")
    for window_s in (0, 1, 10, 11, 600):
        near = {t: [o != "success" for us, o in log if t - window_s <= us // 1_000_000 <= t] for t in times}
        got = windows.failure_rate(rows, window_s)
        assert {r["at_s"]: r["rate"] for r in got.collect()} == {t: sum(bad) / len(bad) for t, bad in near.items()}
        assert got.count() == len(set(times))
    assert "SinglePartition" not in plan_of(got)


def test_ranks_are_numbered_in_spans(spark):
    """As one row_number() for each class, with missing classes, missing and odd priorities and ties; no task holds a whole class."""
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0]
    rng = random.Random(5)
    rows = [(i, rng.choice(["normal", "failure", None]), rng.choice([*odd, 1.0, 1.0, rng.uniform(-200, 50)]), rng.randrange(9)) for i in range(3000)]
    tasks = spark.createDataFrame(rows, "off long, demand string, priority double, enqueue_ms long")
    ranked = windows.ranked(tasks)
    plain = tasks.withColumn("rank", F.row_number().over(Window.partitionBy("demand").orderBy("priority", "enqueue_ms", "off")))
    assert sorted(map(str, ranked.collect())) == sorted(map(str, plain.collect()))
    assert windows.ranked(tasks.where("false")).count() == 0
    assert windows.ranked(tasks.withColumn("priority", F.lit(None).cast("double"))).count() == 3000
    assert "windowspecdefinition(demand" not in plan_of(ranked) and "windowspecdefinition(_place" in plan_of(ranked)


def test_offsets_are_numbered_in_hours(spark, tmp_path):
    from keystrand.sources.log import event_log

    rng = random.Random(6)
    rows = [(i, None if i % 90 == 0 else rng.randrange(30_000), None if i % 40 == 0 else rng.randrange(9), "error") for i in range(2000)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    events.drop("s").write.parquet(f"{tmp_path}/events.parquet")
    log = event_log(spark, str(tmp_path))
    plain = events.withColumn("off", F.row_number().over(Window.partitionBy((F.col("user_id") % 4).cast("int")).orderBy("ts", "event_id")) - 1)
    assert {(r["event_id"], r["off"]) for r in log.collect()} == {(r["event_id"], r["off"]) for r in plain.collect()}
    assert log.count() == 2000 and "windowspecdefinition(_place" in plan_of(log.select("off"))
    assert "Join" not in plan_of(log.select("key"))  # nothing is numbered where no offset is asked for


def test_folds_go_over_batches(spark):
    """Deferral and deduplication over keys that span many batches, one with rows of its own type kept; no group is made for a key."""
    rng = random.Random(18)
    rows, want = [], {}
    for k in range(9):
        own = [(off, off * 3 + rng.randrange(3), rng.choice(["success", "transient"]), rng.randint(0, 3)) for off in range(k * 6)]
        rows += [("t", None if k == 4 else 0, f"k{k}", off, off, at, o, f, b"\x00" * k) for off, at, o, f in own]
        want |= {(f"k{k}", off): x for off, x in queue_by_force(own, 2).items()}
    df = spark.createDataFrame(rows, "topic string, part int, key string, ord bigint, off bigint, at_s bigint, outcome string, fails int, blob binary").repartition(5)
    df = df.withColumn("id", F.concat(F.lit("i"), F.col("off") % 4)).withColumn("ts_us", F.col("at_s") * 1_000_000).withColumn("payload", F.lit("{}"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        replayed, kept = defer.replay(df, base_s=2), dedup.with_ttl(df, 60)
        assert {(r["key"], r["off"]): (r["action"], r["done_s"]) for r in replayed.collect()} == want
        assert all(len(r["blob"]) == int(r["key"][1:]) for r in replayed.collect())
        seen, left = {}, set()
        for _, _, key, _, off, at, o, _, _ in rows:
            if at >= seen.get((key, off % 4), 0):
                left.add((key, off))
                if o == "success":
                    seen[key, off % 4] = at + 60
        assert {(r["key"], r["off"]) for r in kept.collect()} == left and len(left) < len(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "InPandas" not in plan_of(replayed) + plan_of(kept)


def test_virtual_time_is_the_same_in_any_order(spark):
    rng = random.Random(19)
    runs = [("t", 0, "k", rng.randrange(1_000_000), rng.randrange(1, 10_000)) for _ in range(3000)]
    totals = set()
    for _ in range(4):
        rng.shuffle(runs)
        df = spark.createDataFrame(runs, "topic string, part int, key string, end_ms long, run_ms long")
        totals.add(windows.virtual_time(df, 1_000_000).first()["vt_ms"])
    assert len(totals) == 1 and totals.pop() == pytest.approx(sum(r * 2 ** (-(1_000_000 - e) / 120_000) for *_, e, r in runs), rel=1e-12)
