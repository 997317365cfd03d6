"""Persistent timers: slabs, scans, re-bucketing and the replay of timer commands."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrand.functions.scalars import NAMESPACE_OID, NAMESPACE_URL, slab_end, slab_of, slab_start, uuid5


def timer_segment_id(group: Column, topic: Column, part: Column) -> Column:
    return uuid5(NAMESPACE_URL, F.concat(group, F.lit(":"), topic, F.lit("/"), part.cast("string")))


def defer_segment_id(group: Column, topic: Column, part: Column) -> Column:
    return uuid5(NAMESPACE_OID, F.concat(topic, F.lit("/"), part.cast("string"), F.lit(":"), group))


def with_slab(timers: DataFrame, size_s: int) -> DataFrame:
    slab = slab_of(F.col("time_s"), size_s)
    return timers.withColumn("slab_id", slab).withColumn("slab_start", slab_start(slab, size_s)).withColumn("slab_end", slab_end(slab, size_s))


def slab_scan(timers: DataFrame, low: int, high: int) -> DataFrame:
    """Triggers of a range of slabs; prunes partitions where the table is partitioned by slab_id."""
    return timers.where(F.col("slab_id").between(low, high))


def due(timers: DataFrame, now_s: int) -> DataFrame:
    """Due timers with how late they are."""
    return timers.where(F.col("time_s") <= now_s).withColumn("late_s", now_s - F.col("time_s"))


def key_scan(timers: DataFrame, key: str) -> DataFrame:
    return timers.where(F.col("key") == key).orderBy("timer_type", "time_s")


def rebucketed(timers: DataFrame, new_size_s: int) -> DataFrame:
    """The same triggers under another slab size."""
    return timers.withColumn("slab_id", slab_of(F.col("time_s"), new_size_s))


def reused_slabs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Slab ids that a migration uses again and so mustn't delete."""
    return old.select("part", "slab_id").distinct().join(new.select("part", "slab_id").distinct(), ["part", "slab_id"], "left_semi")


def completed_slabs(loaded: DataFrame, timers: DataFrame, now_s: int, size_s: int) -> DataFrame:
    """Loaded slabs that lie behind now and hold no timer any more."""
    return loaded.where(slab_end(F.col("slab_id"), size_s) <= now_s).join(timers.select("part", "slab_id"), ["part", "slab_id"], "left_anti")


def key_states(timers: DataFrame) -> DataFrame:
    """absent, inline or overflow by how many times a (key, type) holds; the latest time sets the TTL."""
    n = timers.groupBy("part", "key", "timer_type").agg(F.count_distinct("time_s").alias("n"), F.max("time_s").alias("latest_s"))
    return n.withColumn("state", F.when(F.col("n") == 0, "absent").when(F.col("n") == 1, "inline").otherwise("overflow"))


def listed_times(timers: DataFrame) -> DataFrame:
    """Times an application sees: scheduled ones, and stored ones that aren't active; those firing aren't."""
    return timers.where(F.coalesce(F.col("state") != "firing", F.lit(True)))


def apply_command(times: dict[int, str], op: str, time_s: int) -> list[str]:
    """One command on the times of a (key, type), each scheduled, firing, firing_rescheduled or stored; returns telemetry events."""
    if op == "schedule":
        state = times.get(time_s)
        if state in ("firing", "firing_rescheduled"):
            times[time_s] = "firing_rescheduled"
            return []
        times[time_s] = "scheduled"
        return ["scheduled"]
    if op == "unschedule":
        state = times.get(time_s)
        if state == "firing_rescheduled":
            times[time_s] = "firing"
        if state not in ("scheduled", "stored"):
            return []
        del times[time_s]
        return ["cancelled"]
    if op == "clear":
        return [e for t in sorted(times) for e in apply_command(times, "unschedule", t)]
    if op == "clear_and_schedule":
        others = sorted(t for t in times if t != time_s)
        for t in others:
            apply_command(times, "unschedule", t)
        apply_command(times, "schedule", time_s)
        return ["cancelled"] * len(others) + ["scheduled"]
    if op == "fire":  # only scheduled timers fire, cancelled ones are gone
        if times.get(time_s) == "scheduled":
            times[time_s] = "firing"
            return ["fired"]
        return []
    if op in ("complete", "abort"):
        state = times.get(time_s)
        if state == "firing_rescheduled":
            times[time_s] = "scheduled"
        elif state == "firing":
            if op == "complete":
                del times[time_s]
            else:
                times[time_s] = "stored"  # the row stays, but fires again after a reload only
        return []
    if op == "reload":
        if times.get(time_s) == "stored":
            times[time_s] = "scheduled"
        return []
    raise ValueError(op)


def replay(commands: DataFrame) -> DataFrame:
    """(part, key, timer_type, time_s, state) left by commands (part, key, timer_type, ord, op, time_s).

    Order matters within a (key, type) only, so each is folded by itself.
    """

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        times: dict[int, str] = {}
        for op, t in part.sort_values("ord")[["op", "time_s"]].itertuples(index=False):
            apply_command(times, op, int(t))
        first = part.iloc[0]
        return pd.DataFrame([(first["part"], first["key"], first["timer_type"], t, s) for t, s in sorted(times.items())], columns=["part", "key", "timer_type", "time_s", "state"])

    return commands.groupBy("part", "key", "timer_type").applyInPandas(fold, "part int, key string, timer_type int, time_s bigint, state string")


def scheduled_after(commands: DataFrame) -> DataFrame:
    """(part, key, timer_type, time_s) left by the commands schedule, unschedule, clear and clear_and_schedule.

    A time stays if it was added after all that removes it: its own unschedule, a clear, or the last clear_and_schedule to
    another time (one to the same time is an add itself). Two grouped maxima and a join, no fold by key.
    """
    key = ["part", "key", "timer_type"]
    last = lambda *ops: F.max(F.when(F.col("op").isin(*ops), F.col("ord")))
    times = commands.groupBy(*key, "time_s").agg(last("schedule", "clear_and_schedule").alias("_added"), last("unschedule").alias("_removed")).where("_added IS NOT NULL")
    cleared = commands.groupBy(*key).agg(last("clear").alias("_cleared"), F.max(F.when(F.col("op") == "clear_and_schedule", F.struct("ord", "time_s"))).alias("_reset"))
    reset = F.when(F.col("_reset.time_s") != F.col("time_s"), F.col("_reset.ord"))
    after = F.coalesce(F.greatest("_removed", "_cleared", reset), F.lit(-(1 << 62)))
    return times.join(cleared, key).where(F.col("_added") > after).select(*key, "time_s")


def load_plan(ticks: DataFrame, preload_s: int, size_s: int) -> DataFrame:
    """(part, now_s, first_slab, last_slab, wait_s): what the loader of a partition loads at each tick, and how long it waits then.

    It loads up to the slab that holds now plus the preload window, from the one after the highest it has loaded (0 at
    first; first > last: nothing), and waits until the next slab comes into the window.
    """
    target = slab_of(F.col("now_s") + preload_s, size_s)
    highest = F.max("last_slab").over(Window.partitionBy("part").orderBy("now_s").rowsBetween(Window.unboundedPreceding, -1))
    planned = ticks.withColumn("last_slab", target).withColumn("first_slab", F.coalesce(highest + 1, F.lit(0)))
    return planned.withColumn("wait_s", F.greatest(F.lit(0), slab_end(F.col("last_slab"), size_s) - F.col("now_s") - preload_s))


def preload_s(size_s: int, jitter: float) -> int:
    """Preload window: a minute, and up to the rest of the slab more by a jitter in [0, 1]."""
    return 60 + round(max(0, size_s - 60) * jitter)


def write_slabs(timers: DataFrame, path: str, size_s: int) -> None:
    """The timers table partitioned by slab, so that a slab scan reads the slabs' folders alone."""
    timers.withColumn("slab_id", slab_of(F.col("time_s"), size_s)).repartition("slab_id").write.mode("overwrite").partitionBy("slab_id").parquet(path)
