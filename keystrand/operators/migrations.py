"""Schema and segment migrations as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.functions.scalars import row_ttl
from keystrand.operators.timers import key_states


def ordered(files: DataFrame) -> DataFrame:
    """Migrations (filename, sql) by their 8-digit date prefix."""
    return files.orderBy(F.substring("filename", 1, 8), "filename")


def substituted(sql: Column, values: dict[str, str]) -> Column:
    """Placeholders {{name}} replaced."""
    for name, value in values.items():
        sql = F.replace(sql, F.lit("{{" + name + "}}"), F.lit(value))
    return sql


def checksum(sql: Column) -> Column:
    return F.sha2(sql, 256)


def statements(sql: Column) -> Column:
    """Statements of a script: comment and blank lines dropped, split behind lines that end in a semicolon."""
    lines = F.filter(F.split(sql, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("--")))
    return F.filter(F.transform(F.split(F.concat(F.array_join(lines, "\n"), F.lit("\n")), r";[ \t]*\n"), F.trim), lambda x: F.length(F.regexp_replace(x, r"\s", "")) > 0)


def pending(files: DataFrame, applied: DataFrame) -> DataFrame:
    return files.join(applied.select("filename"), "filename", "left_anti")


def validated(files: DataFrame, applied: DataFrame) -> DataFrame:
    """(filename, status): ok, changed (checksums differ) or unknown (applied, but no such file)."""
    both = applied.select("filename", F.col("checksum").alias("_was")).join(files.select("filename", checksum(F.col("sql")).alias("_is")), "filename", "left")
    return both.select("filename", F.when(F.col("_is").isNull(), "unknown").when(F.col("_is") != F.col("_was"), "changed").otherwise("ok").alias("status"))


def upgraded_timers(v1: DataFrame, slab_size_s: int) -> DataFrame:
    """Untyped timers (key, time_s) as application timers under typed slabs; a null version counts as 1."""
    return v1.withColumn("timer_type", F.lit(0).cast("tinyint")).withColumn("slab_id", F.floor(F.col("time_s") / slab_size_s)).withColumn("version", F.greatest(F.coalesce("version", F.lit(1)), F.lit(3)))


def backfilled_states(timers: DataFrame, now_s: int, retention_s: int) -> DataFrame:
    """Key states of typed timers, as the last upgrade writes them: one time stands inline, of several only that they overflow,
    kept as long as their latest."""
    states = key_states(timers).where("n > 0")
    inline = F.when(F.col("state") == "inline", F.col("latest_s"))
    return states.select("part", "key", "timer_type", "state", inline.alias("inline_s"), row_ttl(F.col("latest_s"), now_s, retention_s).alias("ttl_s"))


def segments(rows: DataFrame) -> DataFrame:
    """Get-or-create: one row per deterministic segment id."""
    return rows.dropDuplicates(["id"])
