"""Streams of files through the stateful processors give what the batch operators give."""

import time

import pytest
from pyspark.sql import functions as F

from keystrand.operators import decode, dedup
from keystrand.sources.log import event_log
from keystrand.streaming import processors

SF = "/root/testdata/sf0.001"


@pytest.fixture
def log_stream(spark, tmp_path):
    rows = decode.identify(event_log(spark, SF)).select(*[c.split()[0] for c in processors.LOG_SCHEMA.split(", ")])
    for k, (low, high) in enumerate([(0, 100), (100, 10**9)]):
        rows.where((F.col("off") >= low) & (F.col("off") < high)).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    return rows, stream


def until(done, query, seconds=90):
    """Streams with timers or a TTL never run out of batches, so they are stopped when the expected rows are there."""
    end = time.monotonic() + seconds
    try:
        while not done() and time.monotonic() < end:
            assert query.exception() is None
            query.awaitTermination(1)
    finally:
        query.stop()


def collected(stream, tmp_path, name, n):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="200 milliseconds").start()
    table = stream.sparkSession.table(name)
    until(lambda: table.count() >= n, query)
    return table.collect()


def test_dedup_stream_equals_batch(spark, tmp_path, log_stream):
    rows, stream = log_stream
    want = {(r["part"], r["off"]) for r in dedup.with_ttl(rows).collect()}
    assert {(r["part"], r["off"]) for r in collected(processors.dedup_stream(stream), tmp_path, "dedup_out", len(want))} == want


def test_defer_stream_equals_batch(spark, tmp_path):
    from keystrand.operators import defer

    log = event_log(spark, SF)
    rows = log.select("topic", "part", "key", "off", F.floor(F.col("ts_us") / 1_000_000).alias("at_s"), "outcome", (F.col("event_id") % 4).alias("fails"))
    for k, (low, high) in enumerate([(0, 100), (100, 10**9)]):
        rows.where((F.col("off") >= low) & (F.col("off") < high)).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    want = {(r["part"], r["off"], r["action"], r["done_s"]) for r in defer.replay(rows.withColumn("ord", F.col("off"))).collect()}
    assert {(r["part"], r["off"], r["action"], r["done_s"]) for r in collected(processors.defer_stream(stream), tmp_path, "defer_out", len(want))} == want


def test_engine_runs_the_pipeline_as_a_stream(spark, tmp_path):
    from keystrand.config import ConsumerSettings
    from keystrand.plans.modes import Engine, State, pipeline

    log = event_log(spark, SF)
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    settings, seen = ConsumerSettings(group_id="analytics"), []
    engine = Engine(spark, settings)
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    query = engine.subscribe(lambda rows: pipeline(rows, lambda r: r, settings), str(tmp_path / "c"), stream, lambda df, _: seen.extend(df.collect()), processingTime="200 milliseconds")
    want = {(r["part"], r["off"], r["action"]) for r in pipeline(log, lambda r: r, settings).collect()}
    assert engine.state is State.RUNNING and engine.live()
    until(lambda: len(seen) >= len(want), query)
    assert {(r["part"], r["off"], r["action"]) for r in seen} == want
    with pytest.raises(RuntimeError):
        engine.subscribe(lambda rows: rows, str(tmp_path / "d"))
    engine.unsubscribe()
    assert engine.state is State.CONFIGURED


def test_timer_stream(spark, tmp_path):
    rows = [(0, "a", 0, 1, "schedule", 60), (0, "a", 0, 2, "schedule", 120), (0, "a", 0, 3, "unschedule", 60), (0, "b", 0, 4, "schedule", 4_000_000_000)]
    df = spark.createDataFrame(rows, "part int, key string, timer_type int, ord bigint, op string, time_s bigint")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = processors.timer_stream(stream).writeStream.format("memory").queryName("timer_out").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            found = {(r["key"], r["time_s"], r["event"]) for r in spark.table("timer_out").collect()}
            if ("a", 120, "fired") in found:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert found == {("a", 60, "scheduled"), ("a", 120, "scheduled"), ("a", 60, "cancelled"), ("b", 4_000_000_000, "scheduled"), ("a", 120, "fired")}
