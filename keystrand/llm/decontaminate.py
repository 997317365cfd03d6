"""Benchmark decontamination with DataFrame functions only.

Normalised windows of the benchmark form a hash set. Its counted size decides into how many parts of bounded size it is cut;
each part is broadcast in a scan of its own (one scan for all but very large benchmarks). Every document is tokenised once; each word position hashes its window inside one code-generated
stage, probes the set, and a probe that answers is verified word by word. Hits are folded back per row.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, ascii_lower, cut

WINDOW = 10
#: Windows (about 150 bytes each) in a broadcast part of the set, about.
MAX_BROADCAST_WINDOWS = 400_000


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(w_len, w_words, w_items): each distinct window once with the items it stands in.

    Items shorter than the window are one window of their own length; items without words have none. Null ids mark
    documents but can't be listed, so they are left out of w_items.
    """
    items = benchmark.select(F.col(item_col).alias("_item"), words(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    length = F.least(F.size("_w"), F.lit(window))
    at = items.select("_item", "_w", length.alias("w_len"), F.explode(F.sequence(F.lit(1), F.size("_w") - length + 1)).alias("_at"))
    return (
        at.select("_item", "w_len", F.slice("_w", F.col("_at"), F.col("w_len")).alias("w_words"))
        .groupBy("w_len", "w_words")
        .agg(F.array_sort(F.collect_set("_item")).alias("w_items"))
    )


def _hash_at(words_col: str, pos: str, length: int) -> Column:
    """Hash of `length` words from position pos (0-based), null where the text ends before."""
    parts = [F.get(F.col(words_col), F.col(pos) + k) for k in range(length)]
    return F.when(F.col(pos) + length <= F.size(words_col), F.xxhash64(*parts))


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """All columns of `documents` but the text, plus n_words, hit_positions (0-based, sorted) and items (sorted ids).

    Null and empty texts: no words, no hits. Repeated rows are judged one by one. Ties can't arise: every window that
    occurs counts. Own columns replace columns of the same name, other names can't clash. An empty benchmark or table is no
    special case. Rows are numbered once: where several scans need the number it is written first.
    """
    windows = benchmark_windows(benchmark, window)
    lengths = sorted((r["w_len"], r["n"]) for r in windows.groupBy("w_len").agg(F.count("*").alias("n")).collect())  # at most `window` rows
    keep = [c for c in documents.columns if c not in (text_col, "n_words", "hit_positions", "items")]
    rounds = math.ceil(sum(n for _, n in lengths) / max_broadcast_windows)
    base = documents.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_pad")).alias("_row"), F.col(f"`{text_col}`").alias("_text"), F.monotonically_increasing_id().alias("_rid"))
    if rounds > 1:
        base = cut(base, "decontaminate-rows")
    base = base.select("_row", words(F.col("_text")).alias("_w"), "_rid")
    if not lengths:
        none = F.array().cast(windows.schema["w_items"].dataType)
        return base.select("_row.*", F.size("_w").cast("long").alias("n_words"), F.array().cast("array<int>").alias("hit_positions"), none.alias("items")).drop("_pad")
    keyed = windows.select(
        "w_words", "w_items", "w_len",
        reduce(lambda a, n: F.when(F.col("w_len") == n, F.xxhash64(*[F.get("w_words", F.lit(k)) for k in range(n)])).otherwise(a), [n for n, _ in lengths], F.lit(None).cast("long")).alias("_key"),
    )
    spots = base.select("_row", "_rid", "_w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)))).alias("_pos"))
    probes = [_hash_at("_w", "_pos", n) for n, _ in lengths]
    if len(probes) == 1:
        probed = spots.select("_row", "_rid", "_w", "_pos", probes[0].alias("_probe"))
    else:
        probed = spots.select("_row", "_rid", "_w", "_pos", F.explode(F.array(*probes)).alias("_probe"))
    verified = (F.col("_probe") == F.col("_key")) & (F.slice("_w", F.col("_pos") + 1, F.col("w_len")) == F.col("w_words"))
    found = None
    for k in range(rounds):
        part = F.broadcast(keyed.where(F.pmod("_key", F.lit(rounds)) == k))
        hits = (
            probed.join(part, verified, "left")
            .where(F.col("w_len").isNotNull() | (F.col("_pos") == 0))
            .select("_row", "_rid", F.when(F.col("_pos") == 0, F.size("_w")).alias("_n"), F.when(F.col("w_len").isNotNull(), F.struct("_pos", "w_len", "w_items")).alias("_hit"))
        )
        found = hits if found is None else found.unionByName(hits)
    folded = found.groupBy("_rid").agg(F.first("_row").alias("_row"), F.max("_n").alias("_n"), F.collect_list("_hit").alias("_hits"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(h["_pos"], h["_pos"] + h["w_len"] - 1)))))
    return folded.select("_row.*", F.col("_n").cast("long").alias("n_words"), covered.alias("hit_positions"), F.array_distinct(F.flatten(F.col("_hits.w_items"))).alias("items")).drop("_pad")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from scan()'s."""
    as_text = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return scanned.select(
        F.col(id_col),
        "n_words",
        F.size("hit_positions").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(as_text, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_positions") > 0).alias("contaminated"),
    )
