"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies (target / source size). Its fractional part is a
probability; pairs of documents transfer word mass at random, in expectation without change, until one of the two is
integral. Chunks do this side by side and leave at most one fractional document each; those meet in a reduction tree of fixed
fan-in until each source has at most one, which is drawn. A hot source has many chunks of about CHUNK_ROWS rows. Documents
without words take no part; other rows that are equal in id and text have equal draws and share a chunk.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, cut

CHUNK_ROWS = 8192
FAN_IN = 64
MAX_COPIES = 3
#: Sources up to which their targets are broadcast.
MAX_BROADCAST_SOURCES = 500_000
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, n_docs, source_size, target) from rows (source, size): one row per source, null a source of its own.

    Sources in code-point order, null last, take the weights in turn. The water level is that of the first source, by cap over weight, which it leaves under its cap: no target
    exceeds max_copies times its source; sources of size 0 get 0.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.select("*", weight.alias("_w"), (F.col("source_size") * max_copies).cast("double").alias("_cap"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_w", "source").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
            / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        ).alias("_level"),
    )
    level = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(everything)
    return per.select("source", "n_docs", "source_size", F.least("_cap", F.coalesce(level, F.lit(0.0)) * F.col("_w")).alias("target"))


def settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Pivotal rounding over one chunk: (size, p) in the order of v with draws u; p becomes null where settled in `extra`."""
    rows = rows.sort_values(["v", "size"], kind="stable").reset_index(drop=True)
    size, p, u = rows["size"].tolist(), rows["p"].tolist(), rows["u"].tolist()
    extra = [0] * len(rows)
    left: list[float | None] = [None] * len(rows)
    c, pc = -1, 0.0
    for j in range(len(rows)):
        pj, aj = p[j], size[j]
        if aj == 0 or pj <= 0.0:
            continue
        if pj >= 1.0:
            extra[j] = 1
            continue
        if c < 0:
            c, pc = j, pj
            continue
        ac = size[c]
        up, down = min(ac * (1 - pc), aj * pj), min(ac * pc, aj * (1 - pj))
        if u[j] * (up + down) < down:  # mass goes from j to c
            if ac * (1 - pc) <= aj * pj:
                extra[c] = 1
                c, pc = j, (aj * pj - up) / aj
            else:
                pc += up / ac
        elif ac * pc <= aj * (1 - pj):  # mass goes from c to j, which takes all of it
            c, pc = j, pj + down / aj
        else:
            extra[j] = 1
            pc -= down / ac
        if not 1e-12 < pc < 1 - 1e-12:
            extra[c] = int(pc > 0.5)
            c = -1
    if c >= 0:
        left[c] = pc
    rows["extra"] = extra
    rows["p"] = pd.array(left, dtype="Float64")
    return rows


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN, max_copies: int = MAX_COPIES, row_id: str | None = None) -> DataFrame:
    """(_rid, doc_id, source, size, source_size, target, copies) for every row of `documents`.

    Null and empty texts have size 0 and no copies. Null ids and repeated rows are rounded like any other; exact repeats are
    interchangeable, so reruns give the same rows. An empty table gives an empty result. _rid is `row_id` (a column of
    numbers of `documents`) if given, else a number of the row's own.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    draw = F.xxhash64(F.col(id_col), text, F.lit(seed))
    sized = cut(
        documents.select(
            (F.monotonically_increasing_id() if row_id is None else F.col(row_id)).alias("_rid"),
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text, F.lit(SPACED_WORD)).cast("long").alias("size"),
            draw.alias("_draw"),
        ),
        "mix-sizes",
    )
    targets = cut(source_targets(sized.select("source", "size"), max_copies=max_copies), "mix-targets")
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    chunks = F.ceil(F.col("n_docs") / chunk_rows)
    to = targets.withColumnRenamed("source", "_source")
    if targets.count() <= MAX_BROADCAST_SOURCES:
        to = F.broadcast(to)  # else a hot source is split by the adaptive skew join
    rows = sized.join(to, F.col("source").eqNullSafe(F.col("_source"))).select(
        "_rid", "doc_id", "source", "size", "source_size", "target",
        F.floor(ratio).cast("int").alias("base"),
        (ratio - F.floor(ratio)).alias("p"),
        "_draw", F.lit(0.0).alias("u"), F.lit(0).cast("long").alias("v"),
        F.pmod(F.xxhash64("_draw"), chunks).alias("chunk"),
    )
    schema = rows.select("*", F.lit(0).alias("extra")).schema
    columns = [f.name for f in schema]

    def chunked(part: pd.DataFrame) -> pd.DataFrame:
        return settle(part)[columns]

    def drawn(rows: DataFrame, level: int) -> DataFrame:
        """Draw u and order v, both new at each level: a draw must not depend on the order, nor on an earlier one."""
        u = F.shiftrightunsigned(F.xxhash64("_draw", F.lit(2 * level)), 11) / float(2**53)
        return rows.withColumn("u", u).withColumn("v", F.xxhash64("_draw", F.lit(2 * level + 1)))

    level = cut(drawn(rows.where("size > 0"), 0).groupBy("source", "chunk").applyInPandas(chunked, schema), "mix-level")
    done = [rows.where("size = 0").withColumn("extra", F.lit(0)), level.where("p IS NULL")]
    rest = level.where("p IS NOT NULL")
    n, depth = math.ceil(most / chunk_rows), 0
    while n > 1:
        n, depth = math.ceil(n / fan_in), depth + 1
        rest = cut(drawn(rest, depth).withColumn("chunk", F.floor(F.col("chunk") / fan_in)).drop("extra").groupBy("source", "chunk").applyInPandas(chunked, schema), "mix-level")
        done.append(rest.where("p IS NULL"))
        rest = rest.where("p IS NOT NULL")
    done.append(drawn(rest, depth + 1).withColumn("extra", (F.col("u") < F.col("p")).cast("int")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("extra")).otherwise(0)
    return out.select("_rid", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def digest(mixed: DataFrame) -> DataFrame:
    """The contract's columns from mix()'s."""
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def take(documents: DataFrame, **options) -> DataFrame:
    """The documents the mix takes, each once, with `copies` (which replaces a column of that name); documents with no copy go.

    Rows are numbered once, in a written table that both sides of the join read.
    """
    own = [c for c in documents.columns if c != "copies"]
    numbered = cut(documents.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), *[F.col(f"`{options.get(o, c)}`").alias(c) for o, c in COLUMNS.items()], F.monotonically_increasing_id().alias("_of")), "mix-rows")
    copies = mix(numbered, row_id="_of", **{k: v for k, v in options.items() if k not in COLUMNS}).where("copies > 0").select("_rid", "copies")
    return numbered.select("_row", "_of").join(copies, F.col("_of") == F.col("_rid")).select("_row.*", "copies")


COLUMNS = {"id_col": "doc_id", "text_col": "text", "source_col": "source"}
