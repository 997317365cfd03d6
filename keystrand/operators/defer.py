"""Deferred queues: heads, successors, loads and the replay of deferral."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from keystrand.functions.folds import columns_of, fold_keys
from keystrand.functions.scalars import row_ttl

QUEUE = ("topic", "part", "key")


def deferred_offsets(log: DataFrame) -> DataFrame:
    """Offsets at or after the first transient failure of their key: what waits in its queue."""
    first = F.min(F.when(F.col("outcome") == "transient", F.col("off"))).over(Window.partitionBy(*QUEUE))
    return log.withColumn("_first", first).where("off >= _first").drop("_first")


def routed(log: DataFrame, deferred_keys: DataFrame) -> DataFrame:
    """Adds queued: messages of a deferred key are appended to its queue instead of handled."""
    marked = deferred_keys.select(*QUEUE).distinct().withColumn("_q", F.lit(True))
    return log.join(marked, list(QUEUE), "left").withColumn("queued", F.coalesce("_q", F.lit(False))).drop("_q")


def heads(queue: DataFrame) -> DataFrame:
    return queue.groupBy(*QUEUE).agg(F.min("off").alias("head"), F.count("*").alias("waiting"))


def after_removal(queue: DataFrame, removed: DataFrame) -> DataFrame:
    """(queue key, removed, next): next is the least offset above the removed one; null: the key leaves the store."""
    gone = removed.select(*QUEUE, F.col("off").alias("removed"))
    above = F.min(F.when(F.col("off") > F.col("removed"), F.col("off")))
    return queue.join(gone, list(QUEUE)).groupBy(*QUEUE, "removed").agg(above.alias("next"))


def visible_times(active: DataFrame, deferred: DataFrame) -> DataFrame:
    """Times of application timers, active or deferred, each once."""
    cols = ["part", "key", "time_s"]
    return active.select(*cols).union(deferred.select(*cols)).distinct()


def bound_s(retry: int, base_s: int = 1, max_s: int = 86_400) -> int:
    """Longest wait before the next try after `retry` failed ones; none before the first."""
    return 0 if retry == 0 else max(1, min(base_s * 2 ** min(retry - 1, 62), max_s))


def busy_for(fails: int, base_s: int = 1, max_s: int = 86_400) -> int:
    """Seconds from a message becoming the head until its last try, after `fails` transient ones."""
    return sum(bound_s(r, base_s, max_s) for r in range(1, fails + 1))


def step(busy: int | None, at_s: int, outcome: str, fails: int, defers: bool = True, base_s: int = 1, max_s: int = 86_400) -> tuple[str, int | None]:
    """(action, busy) of a message that arrives while its key's queue lasts until `busy`.

    A key with a queue appends. A head's retry timer is due at once, then after waits that grow with its failures; each
    message that ends hands over to the next, so a queue lasts until all its messages have ended. Without one, the
    handler decides: a transient failure starts a queue, unless the decider is against it.
    """
    if busy is not None and at_s < busy:
        return "queued", busy + busy_for(fails, base_s, max_s)
    if outcome != "transient":
        return "handled", None
    return ("deferred", at_s + busy_for(fails, base_s, max_s)) if defers else ("failed", None)


def replay(events: DataFrame, keys: tuple[str, ...] = QUEUE, base_s: int = 1, max_s: int = 86_400) -> DataFrame:
    """What becomes of each message: columns of `events` plus action (handled, failed, deferred or queued) and done_s, when its
    last try ends (null where it never was deferred).

    events: key columns, ord, at_s, outcome (of a call on arrival), fails (transient tries from its queue) and, if there,
    defers (what the decider says). A lost or refused load is a try like any other. Waits are taken at their bounds. Order
    matters within a key only, so each is folded by itself; timers are deferred alike, with ord their original time.
    """
    rows = events if "defers" in events.columns else events.withColumn("defers", F.lit(True))
    rows = rows.drop("action", "done_s")
    schema = StructType([*rows.schema.fields, StructField("action", StringType()), StructField("done_s", LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, busy = None, None
        for batch in batches:
            actions, done = [], []
            for at, outcome, fails, defers, *key in columns_of(batch, ["at_s", "outcome", "fails", "defers", *keys]):
                if key != last:
                    last, busy = key, None
                action, busy = step(busy, int(at), outcome, int(fails), bool(defers), base_s, max_s)
                actions.append(action)
                done.append(busy)
            columns = [*batch.columns, pa.array(actions, pa.string()), pa.array(done, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "action", "done_s"])

    return fold_keys(rows, keys, "ord", fold, schema)


def waits(retry: Column, base_s: int = 1, max_s: int = 86_400) -> Column:
    """Sum of the bounds of the waits before the first `retry` tries."""
    each = lambda r: F.greatest(F.lit(1), F.least(F.pow(F.lit(2.0), r - 1) * base_s, F.lit(max_s))).cast("long")
    return F.when(retry > 0, F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(retry, F.lit(1))), each), F.lit(0).cast("long"), lambda a, b: a + b)).otherwise(F.lit(0).cast("long"))


def retries(replayed: DataFrame, base_s: int = 1, max_s: int = 86_400) -> DataFrame:
    """One row for each try of a deferred or queued message: attempt (from 0), at_s and whether it failed."""
    fails = F.col("fails").cast("int")
    rows = replayed.where(F.col("action").isin("deferred", "queued")).withColumn("attempt", F.explode(F.sequence(F.lit(0), fails)))
    begun = F.col("done_s") - waits(fails, base_s, max_s)
    return rows.withColumn("at_s", begun + waits(F.col("attempt"), base_s, max_s)).withColumn("failed", F.col("attempt") < fails)


def waiting_at(replayed: DataFrame, at_s: int) -> DataFrame:
    """What is in a queue at an instant: arrived by then, deferred or queued, and not ended."""
    return replayed.where(F.col("action").isin("deferred", "queued") & (F.col("at_s") <= at_s) & (F.col("done_s") > at_s))


def timer_heads(waiting: DataFrame, now_s: int, retention_s: int) -> DataFrame:
    """(part, key, head_s, waiting, ttl_s): a timers' queue leads with its least original time, whose own time sets how long it is kept."""
    heads = waiting.groupBy("part", "key").agg(F.min("ord").alias("head_s"), F.count("*").alias("waiting"))
    return heads.withColumn("ttl_s", row_ttl(F.col("head_s"), now_s, retention_s))


def decided(strategy: str, rate: Column | None = None, threshold: float = 0.9, trace: Column | None = None) -> Column:
    """Whether a transient failure is deferred: always, never, by a column of given answers (trace), or by the failure rate."""
    if strategy in ("always", "never"):
        return F.lit(strategy == "always")
    if strategy == "trace":
        return F.coalesce(trace, F.lit(True))
    if strategy == "rate":
        return rate < threshold
    raise ValueError(strategy)
