"""Failure rate, monopolization, virtual time, scheduling and heartbeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrand.functions.order import numbered, span_of

KEY = ("topic", "part", "key")
HALF_LIFE_S = 120.0
#: Spans of priorities in which tasks are ranked.
RANK_SPANS = 64


def failure_rate(results: DataFrame, window_s: int = 300) -> DataFrame:
    """(at_s, rate): over all keys, the share of failures among results of the last window_s seconds, each second with a result.

    Summed by second first, with partial sums. A second's results enter a running sum and leave it window_s later, so a row
    costs the same for any window. The sums run in spans of a window's length; what a span inherits enters at its start.
    """
    span = window_s + 1
    by_second = results.where("ts_us IS NOT NULL").groupBy(F.floor(F.col("ts_us") / 1_000_000).alias("at_s")).agg(
        F.sum(F.when(F.col("outcome") == "success", 0).otherwise(1)).alias("bad"), F.count("*").alias("n")
    )
    at = F.col("at_s")
    change = lambda when, sign, here: F.struct(when.alias("at_s"), (sign * F.col("bad")).alias("bad"), (sign * F.col("n")).alias("n"), F.lit(here).alias("_here"))
    # leaves at at_s + span: in its own span never, as that is the same place in the next one
    begin = (F.floor(at / span) + 1) * span
    changes = by_second.select(F.explode(F.array(change(at, 1, 1), change(begin, 1, 0), change(at + span, -1, 0))).alias("_c"), F.col("at_s").alias("_from"))
    in_span = F.when(F.col("_c.at_s") == F.col("_from"), F.floor(F.col("_from") / span)).otherwise(F.floor(F.col("_from") / span) + 1)
    changes = changes.select(in_span.alias("_span"), "_c.*").groupBy("_span", "at_s").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.max("_here").alias("_here"))
    w = Window.partitionBy("_span").orderBy("at_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = changes.select("at_s", "_here", F.sum("bad").over(w).alias("_bad"), F.sum("n").over(w).alias("_n"))
    return summed.where("_here = 1").select("at_s", (F.col("_bad") / F.col("_n")).alias("rate"))


def defers(rate: Column, threshold: float = 0.9, enabled: bool = True) -> Column:
    return (rate < threshold) & F.lit(enabled)


def disjoint(invocations: DataFrame) -> DataFrame:
    """Ends capped at the next start of the same key: one key never runs twice at once."""
    nxt = F.lead("start_ms").over(Window.partitionBy(*KEY).orderBy("start_ms", "off"))
    return invocations.withColumn("end_ms", F.least("end_ms", F.coalesce(nxt, F.col("end_ms"))))


def monopolization(invocations: DataFrame, window_ms: int = 300_000, threshold: float = 0.9) -> DataFrame:
    """Adds ratio and rejected: the share of the window before each start in which the key's own invocations ran.

    Intervals of a key are disjoint and end in order, so the sum of those that end in the window, less what lies before it,
    is the overlap; no range join.
    """
    w = Window.partitionBy(*KEY).orderBy("end_ms").rangeBetween(-window_ms, 0)
    ends = invocations.select(*KEY, F.lit(None).cast("long").alias("off"), F.col("end_ms"), "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("run"))
    starts = invocations.select(*KEY, "off", F.col("start_ms").alias("end_ms"), F.lit(None).cast("long").alias("start_ms"), F.lit(0).cast("long").alias("run"))
    both = ends.unionByName(starts)
    begun = F.min("start_ms").over(w)
    busy = F.sum("run").over(w) - F.greatest(F.lit(0), F.col("end_ms") - window_ms - begun)
    rated = both.select(*KEY, "off", F.coalesce(busy, F.lit(0)).alias("busy_ms")).where("off IS NOT NULL")
    return rated.select(*KEY, "off", "busy_ms", (F.col("busy_ms") / window_ms).alias("ratio"), (F.col("busy_ms") > threshold * window_ms).alias("rejected"))


def virtual_time(runs: DataFrame, now_ms: int, half_life_s: float = HALF_LIFE_S) -> DataFrame:
    """(key columns, vt_ms): every run's duration decayed from its end to now, added up.

    Each term is decayed by its own age, so nothing overflows, and the sum needs no order and combines map-side. Terms are added
    as decimals: the sum is the same in any order, so what is read twice (ranked()) agrees to the last bit.
    """
    age = (F.lit(now_ms) - F.col("end_ms")) / 1000.0
    term = (F.col("run_ms") * F.pow(F.lit(2.0), -age / half_life_s)).cast("decimal(38,18)")
    return runs.where(F.col("end_ms") <= now_ms).groupBy(*KEY).agg(F.sum(term).cast("double").alias("vt_ms"))


def class_time(runs: DataFrame, now_ms: int, half_life_s: float = HALF_LIFE_S) -> DataFrame:
    age = (F.lit(now_ms) - F.col("end_ms")) / 1000.0
    return runs.where(F.col("end_ms") <= now_ms).groupBy("demand").agg(F.sum(F.col("run_ms") * F.pow(F.lit(2.0), -age / half_life_s)).alias("class_ms"))


def priorities(tasks: DataFrame, now_ms: int, wait_weight: float = 200.0, max_wait_s: float = 120.0) -> DataFrame:
    """Adds priority: virtual time less a bonus that grows with the square of the wait."""
    wait = (F.lit(now_ms) - F.col("enqueue_ms")) / 1000.0
    share = F.least(wait / max_wait_s, F.lit(1.0))
    return tasks.withColumn("priority", F.col("vt_ms") / 1000.0 - wait_weight * share * share)


def ranked(rated: DataFrame) -> DataFrame:
    """Adds rank: the order in which a class's tasks are picked.

    Tasks are ranked within spans of priority that hold about equally many. The bounds are approximate quantiles from a first pass;
    any bounds give the same ranks.
    """
    cuts = rated.agg(F.percentile_approx("priority", [i / RANK_SPANS for i in range(1, RANK_SPANS)], 10_000)).first()[0]
    bounds = sorted({b for b in cuts or [] if b == b})
    return numbered(rated, "rank", ["demand"], span_of(F.col("priority"), bounds), ["priority", "enqueue_ms", "off"]).withColumn("rank", F.col("rank").cast("int"))


def next_class(class_times: DataFrame, failure_weight: float = 0.3) -> DataFrame:
    """One row (demand): the class with less time for its weight; normal on a tie, a weight of 0 never."""
    cost = lambda name, weight: F.coalesce(F.max(F.when(F.col("demand") == name, F.col("class_ms"))), F.lit(0.0)) / weight if weight else F.lit(float("inf"))
    return class_times.agg(F.when(cost("normal", 1 - failure_weight) <= cost("failure", failure_weight), "normal").otherwise("failure").alias("demand"))


def schedule_pick(ranked: DataFrame, chosen: DataFrame) -> DataFrame:
    """The first task of the chosen class, or of the other where that has none: a minimum per class, without a sort."""
    order = F.struct("priority", "enqueue_ms", "off")
    columns = F.struct(*[c for c in ranked.columns if c != "rank"])
    first = ranked.groupBy(F.col("demand").alias("_class")).agg(F.min_by(columns, order).alias("_task")).join(chosen.select(F.col("demand").alias("_chosen")), how="cross")  # a row per class
    return first.orderBy((F.col("_class") != F.col("_chosen")).cast("int")).limit(1).select("_task.*")


def heartbeat_edges(beats: DataFrame, threshold_s: int = 300) -> DataFrame:
    """(topic, part, ts_us, gap_us, stalled): a beat's distance from the one before, and whether that was a stall."""
    gap = F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy("topic", "part").orderBy("ts_us", "off"))
    return beats.select("topic", "part", "off", "ts_us", gap.alias("gap_us"), F.coalesce(gap > threshold_s * 1_000_000, F.lit(False)).alias("stalled"))


def interval_overlap(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Length of the intersection of two intervals, 0 if they don't meet."""
    return F.greatest(F.lit(0), F.least(end, hi) - F.greatest(start, lo))
