"""Commit watermarks and stalls of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BY = ("topic", "part")


def commit_watermark(tracked: DataFrame, committed: Column) -> DataFrame:
    """(topic, part, watermark, commit_position): the last offset of the committed prefix, null where there is none.

    Two conditional aggregates: the first open offset, then the last one below it; gaps in the offsets don't matter.
    """
    flagged = tracked.select(*BY, "off", committed.alias("_done"))
    open_ = flagged.groupBy(*BY).agg(F.min(F.when(~F.col("_done"), F.col("off"))).alias("_open"))
    below = F.col("_done") & (F.col("off") < F.coalesce("_open", F.lit(2**63 - 1)))
    return flagged.join(open_, list(BY)).groupBy(*BY).agg(F.max(F.when(below, F.col("off"))).alias("watermark")).withColumn("commit_position", F.col("watermark") + 1)


def stalled(tracked: DataFrame, taken: Column, taken_us: Column, now_us: int, threshold_s: int = 300) -> DataFrame:
    """(topic, part, off, stalled): the oldest offset still taken of each partition, and whether for too long."""
    first = tracked.where(taken).groupBy(*BY).agg(F.min_by(F.struct("off", taken_us.alias("at")), "off").alias("f"))
    return first.select(*BY, F.col("f.off").alias("off"), (F.col("f.at") + threshold_s * 1_000_000 <= now_us).alias("stalled"))


def partition_status(tracked: DataFrame, stalled_rows: DataFrame) -> DataFrame:
    """One row: assigned partitions, and whether any of them stalls."""
    assigned = tracked.select(*BY).distinct().agg(F.count("*").alias("assigned"))
    return assigned.crossJoin(stalled_rows.agg(F.coalesce(F.bool_or("stalled"), F.lit(False)).alias("any_stalled")))
