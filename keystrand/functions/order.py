"""Row numbers that don't put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, name: str, by: list[str], span: Column, order: list[str]) -> DataFrame:
    """Adds `name`: what row_number() over `by` in this order gives, as a long.

    span never falls along the order (null first). Rows are numbered within their span, and the sizes of the spans before it are
    added, so a task holds spans, not groups. rows is read twice and must give the same rows each time.
    """
    placed = rows.withColumn("_place", F.struct(*by, span.alias("_span")))  # a struct: null equals null in it
    sizes = placed.groupBy("_place").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*[f"_place.{c}" for c in by]).orderBy("_place._span").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("_place").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = placed.withColumn("_within", F.row_number().over(Window.partitionBy("_place").orderBy(*order)))
    found = within.join(F.broadcast(starts), F.col("_place") == F.col("_at"), "left")
    return found.withColumn(name, F.col("_before") + F.col("_within")).drop("_place", "_within", "_at", "_before")


def span_of(value: Column, bounds: list[float]) -> Column:
    """How many of the ascending bounds are no larger than the value, by halving; null for null."""
    if not bounds:
        return F.when(value.isNotNull(), 0)
    inner = lambda lo, hi: F.lit(lo) if lo == hi else F.when(value < F.lit(bounds[(lo + hi) // 2]), inner(lo, (lo + hi) // 2)).otherwise(inner((lo + hi) // 2 + 1, hi))
    return F.when(value.isNotNull(), inner(0, len(bounds)))
