"""Message filters in front of the handler, in their order: stale, loop, event type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrand.functions.scalars import starts_with_any


def with_stale(log: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Adds stale: the offset isn't above all offsets that arrived before it in its partition."""
    before = Window.partitionBy("topic", "part").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("stale", F.col("off") <= F.coalesce(F.max("off").over(before), F.lit(-1)))


def is_loop(source_system: Column, group: str) -> Column:
    return F.coalesce(source_system == group, F.lit(False))


def is_unwanted_type(type_: Column, prefixes: list[str]) -> Column:
    """No prefixes, or no string type: wanted."""
    return F.lit(False) if not prefixes else F.coalesce(~starts_with_any(type_, prefixes), F.lit(False))


def drop_reason(group: str, prefixes: list[str]) -> Column:
    """loop or type for rows that are dropped and committed, null for those that go on."""
    return F.when(is_loop(F.col("source_system"), group), "loop").when(is_unwanted_type(F.col("type"), prefixes), "type")


def accepted(log: DataFrame, group: str, prefixes: list[str]) -> DataFrame:
    """What reaches the handler; predicates only, so they go below everything stateful."""
    return log.where(drop_reason(group, prefixes).isNull())
