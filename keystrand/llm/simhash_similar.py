"""Near-duplicate groups by SimHash candidates and exact Jaccard similarity of word-shingle sets.

Two 64-bit SimHash lanes over the distinct five-word shingles sketch every text. Equal shingle sets are one class. Classes meet
under masked bit patterns of both lanes, the upper nodes of the index. A first pass goes through each node in Gray order,
verifies every class's nearest neighbours on the shingle sets and contracts what they link. A second pass settles all that is
left: in each node all pairs of different clusters within a wide radius are found, and the shingle sets of their
members meet in the node's task, which verifies them there and hands on a spanning forest. No pair is written in it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut
from .simhash_gray import SEED, components, forest, gray_rank, majority, mixed, runs_of, shingle_hashes, signed

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits of both lanes up to which a pair is verified: 0.8 gives about 19 of 128, with a deviation of about 4.
WIDE = 34
#: Masked patterns per class and their bits.
TABLES, BITS = 44, 12
#: Classes and shingles of a pattern from which it is dealt in blocks.
NODE_ROWS, NODE_SHINGLES = 4096, 8_000_000
#: Neighbours in Gray order that the first pass looks at, and candidates that a class takes of them.
AHEAD, TAKE = 16, 2
#: Keys up to which the shingle sets' owners are broadcast to find their texts.
MAX_BROADCAST_KEYS = 1_000_000


def sketches(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, thash, fp, fp2, n, cid, s): thash is the text's hash, n the number of its distinct shingles, cid the hash of
    their set and s the set itself, packed."""
    kind = documents.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(2):
                one = np.unique(shingle_hashes(x.as_py(), SHINGLE))
                found.append((signed(majority(one)), signed(majority(mixed(one))), len(one), signed(xxh64_intdigest(one.tobytes(), SEED)), np.unique((one >> np.uint64(32)).astype(np.uint32)).tobytes()))
            cols = list(zip(*found, strict=True)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["doc_id", "thash", "fp", "fp2", "n", "cid", "s"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("thash"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, thash bigint, fp bigint, fp2 bigint, n bigint, cid bigint, s binary")


def masks(tables: int = TABLES, bits: int = BITS, seed: int = 5) -> list[tuple[int, int]]:
    """(lane, mask): fixed pseudo-random bit sets, lanes in turn."""
    draw = random.Random(seed)
    return [(k % 2, sum(1 << p for p in draw.sample(range(64), bits))) for k in range(tables)]


def under_patterns(classes: DataFrame) -> DataFrame:
    """The rows of `classes` under each of their masked patterns: k, its number, and pattern, its hash with the bits."""
    lanes = ("fp", "fp2")
    found = [F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), F.col(lanes[lane]).bitwiseAND(F.lit(signed(m)))).alias("pattern")) for k, (lane, m) in enumerate(masks())]
    return classes.select("*", F.explode(F.array(*found)).alias("_t")).select(*classes.columns, "_t.k", "_t.pattern")


def large_patterns(rows: DataFrame, node_rows: int) -> DataFrame | None:
    """(_pattern, _parts) of the patterns with more classes or shingles than a block may hold; None if there are none."""
    parts = F.greatest(F.ceil(2 * F.count("*") / node_rows), F.ceil(2 * F.sum("n") / NODE_SHINGLES))
    large = rows.groupBy("pattern").agg(F.count("*").alias("_n"), F.sum("n").alias("_s"), parts.alias("_parts")).where((F.col("_n") > node_rows) | (F.col("_s") > NODE_SHINGLES))
    large = cut(large.select(F.col("pattern").alias("_pattern"), "_parts"), "large-patterns")
    return large if large.limit(1).count() else None


def similar(a: int | np.ndarray, b: int | np.ndarray, common: int | np.ndarray) -> bool | np.ndarray:
    return common >= SIMILARITY * (a + b - common)


def neighbours(classes: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """(a, b): for each class of (cid, fp, fp2, n) the nearest that stand near it in Gray order under a pattern. It only has to
    find links that shrink the second pass, so a large pattern's classes meet in parts."""
    rows = under_patterns(classes.select("cid", "fp", "fp2", "n"))
    large = large_patterns(rows, node_rows)
    block = F.col("pattern")
    if large is not None:
        rows = rows.join(F.broadcast(large) if large.count() <= MAX_BROADCAST_KEYS else large, F.col("pattern") == F.col("_pattern"), "left")
        block = F.when(F.col("_parts").isNull(), F.col("pattern")).otherwise(F.xxhash64("pattern", F.pmod(F.col("cid"), F.col("_parts"))))
    dealt = rows.select(block.alias("block"), "cid", "fp", "fp2", "n").repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in runs_of(batches, 1):
            order = np.lexsort((gray_rank(columns[2].view(np.uint64)), columns[0]))
            block, cid, fp, fp2, n = (c[order] for c in columns)
            x, y = fp.view(np.uint64), fp2.view(np.uint64)
            found = [(np.zeros(0, np.int64),) * 3]
            for d in range(1, AHEAD + 1):
                i = np.flatnonzero(block[d:] == block[:-d])
                if not len(i):
                    break
                j = i + d
                apart = np.bitwise_count(x[i] ^ x[j]).astype(np.int64) + np.bitwise_count(y[i] ^ y[j])
                ok = (apart <= WIDE) & (np.minimum(n[i], n[j]) >= SIMILARITY * np.maximum(n[i], n[j]))
                i, j, apart = i[ok], j[ok], apart[ok]
                found += [(i, apart, j), (j, apart, i)]
            own, apart, other = (np.concatenate(v) for v in zip(*found, strict=True))
            order = np.lexsort((cid[other], apart, own))
            own = own[order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
            few = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))) < TAKE
            yield pa.RecordBatch.from_arrays([pa.array(cid[own[few]]), pa.array(apart[order][few]), pa.array(cid[other[order][few]])], names=["a", "apart", "b"])

    near = dealt.mapInArrow(run, "a bigint, apart bigint, b bigint").distinct()
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))).where(F.col("_r") <= TAKE)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingle_sets(keys: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, s): the packed shingle sets of the classes of `keys` (cid, each once), from those of sketches()."""
    keys = cut(keys.join(classes.select("cid", "rep.doc_id", "rep.thash"), "cid").select("cid", F.col("doc_id").alias("_doc"), F.col("thash").alias("_thash")), "verify-keys")
    owners = F.broadcast(keys.drop("cid")) if keys.count() <= MAX_BROADCAST_KEYS else keys.drop("cid")
    owned = rows.select("doc_id", "thash", "cid", "s").join(owners, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("thash") == F.col("_thash")), "left_semi")
    return owned.select("cid", "s").dropDuplicates(["cid"])


def verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of SIMILARITY or more."""
    both = pairs.join(shingles.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a").join(shingles.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(sa.as_py(), np.uint32), np.frombuffer(sb.as_py(), np.uint32)
                keep.append(similar(len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(compare, "a bigint, b bigint")


def unsettled(active: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """(block, cid, root): the classes that have, in a block, a class of another root within WIDE, from rows (cid, root, fp, fp2, n).

    A pair counts under the first pattern that it shares. Patterns of one root alone have none. A large pattern's parts
    meet two by two in blocks, so no pair of it is lost.
    """
    rows = under_patterns(active)
    bits = np.array([m for _, m in masks()], np.uint64)
    lane = [k for k, _ in masks()]
    large = large_patterns(rows, node_rows)
    if large is not None:
        mixed_roots = rows.groupBy("pattern").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("pattern")
        large = cut(large.join(mixed_roots.withColumnRenamed("pattern", "_mixed"), F.col("_pattern") == F.col("_mixed"), "left").select("_pattern", F.when(F.col("_mixed").isNotNull(), F.col("_parts")).otherwise(0).alias("_parts")), "mixed-patterns")
        part = F.pmod(F.col("cid"), F.greatest(F.col("_parts"), F.lit(1)))
        rows = rows.join(F.broadcast(large) if large.count() <= MAX_BROADCAST_KEYS else large, F.col("pattern") == F.col("_pattern"), "left")
        rows = rows.withColumn("_parts", F.coalesce("_parts", F.lit(1))).where("_parts > 0").withColumn("_part", part)
        rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
        block = F.when(F.col("_parts") == 1, F.col("pattern")).otherwise(F.xxhash64("pattern", F.least("_part", "_other"), F.greatest("_part", "_other")))
        side = F.when(F.col("_part") == F.col("_other"), -1).otherwise(F.col("_part")).cast("bigint")
    else:
        block, side = F.col("pattern"), F.lit(-1).cast("bigint")
    dealt = rows.select(block.alias("block"), "k", "cid", "root", "fp", "fp2", "n", side.alias("side")).repartition("block").sortWithinPartitions("block", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table, cid, root, fp, fp2, n, side in runs_of(batches, 1):
            lanes = (fp.view(np.uint64), fp2.view(np.uint64))
            hit = np.zeros(len(n), bool)
            d, i = 1, np.arange(len(n) - 1)
            while len(i := i[i + d < len(n)]):
                i = i[(block[i + d] == block[i]) & (n[i] >= SIMILARITY * n[i + d])]  # sorted by n, so it holds for less d as well
                p = i[(root[i] != root[i + d]) & ((side[i] != side[i + d]) | (side[i] < 0))]
                apart = np.bitwise_count(lanes[0][p] ^ lanes[0][p + d]).astype(np.int64) + np.bitwise_count(lanes[1][p] ^ lanes[1][p + d])
                p = p[apart <= WIDE]
                if len(p):
                    differ = [x[p] ^ x[p + d] for x in lanes]
                    for k in range(int(table[p].max())):
                        p_first = (table[p] <= k) | (differ[lane[k]] & bits[k] != 0)
                        p, differ = p[p_first], [x[p_first] for x in differ]
                    hit[p] = hit[p + d] = True
                d += 1
            yield pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in (block, cid, root)], names=["block", "cid", "root"])

    return dealt.mapInArrow(run, "block bigint, cid bigint, root bigint")


def alike(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of sets whose Jaccard similarity is SIMILARITY or more, by lists of each element's owners; as a
    spanning forest of each set's partners, so the pairs of all sets don't add up."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    by = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[by], np.arange(code.max(initial=-1) + 2))
    listed, ends = owner[by], np.cumsum(size)
    root = np.arange(len(sets))
    at, bt = [], []
    for i in range(len(sets) - 1):
        own = code[ends[i] - size[i] : ends[i]]
        long = starts[own + 1] - starts[own]
        last = np.cumsum(long)
        owners = listed[np.arange(last[-1]) + np.repeat(starts[own] - last + long, long)] if len(last) else own
        common = np.bincount(owners, minlength=len(sets))
        j = np.flatnonzero(similar(size[i], size, common) & (np.arange(len(sets)) > i) & (root != root[i]))
        if len(j):
            at.append(np.full(len(j), i))
            bt.append(j)
            old = np.unique(np.append(root[j], root[i]))
            root[np.isin(root, old)] = old[0]
    return (np.concatenate(at), np.concatenate(bt)) if at else (np.zeros(0, np.int64),) * 2


def settled(hits: DataFrame, shingles: DataFrame) -> DataFrame:
    """(a, b): links of roots that span every block's verified pairs, from rows (block, cid, root) and (cid, s)."""
    dealt = hits.join(shingles, "cid").select("block", "root", "s").repartition("block").sortWithinPartitions("block")

    def of_block(root: np.ndarray, sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        i, j = alike([np.frombuffer(x, np.uint32) for x in sets])
        name, at = np.unique(root, return_inverse=True)
        low = forest(len(name), at[i], at[j])
        moved = np.flatnonzero(low != np.arange(len(name)))
        return name[low[moved]], name[moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, roots, sets = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def finish(upto: int) -> None:
            starts = np.flatnonzero(np.append(True, blocks[1:upto] != blocks[: upto - 1])).tolist() if upto else []
            for s, e in zip(starts, [*starts[1:], upto], strict=True):
                if e - s > 1:
                    for out, x in zip((a, b), of_block(roots[s:e], sets[s:e]), strict=True):
                        out.append(x)

        for batch in batches:
            blocks = np.concatenate([blocks, np.asarray(batch.column(0))])
            roots = np.concatenate([roots, np.asarray(batch.column(1))])
            sets += batch.column(2).to_pylist()
            upto = int(np.searchsorted(blocks, blocks[-1])) if len(blocks) else 0  # the last block may go on
            finish(upto)
            blocks, roots, sets = blocks[upto:], roots[upto:], sets[upto:]
        finish(len(blocks))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def moved_to(rows: DataFrame, clusters: DataFrame, col: str = "root") -> DataFrame:
    """`rows` with `col` taken to its cluster by (node, root); what isn't in it stays."""
    to = clusters.toDF("_node", "_to")
    return rows.join(to, F.col(col) == F.col("_node"), "left").withColumn(col, F.coalesce("_to", col)).drop("_node", "_to")


def groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", node_rows: int = NODE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, stay): rows of sketches() for every document; stay (doc_id, thash) of each group's kept document.

    Texts without words have no shingles: they are alike only among each other. Null ids come last as a group's kept one.
    """
    rows = cut(sketches(documents, id_col, text_col), "sketches")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("thash"))
    classes = cut(rows.groupBy("cid").agg(F.first("fp").alias("fp"), F.first("fp2").alias("fp2"), F.first("n").alias("n"), F.min(rank).alias("rep")), "similar-classes")
    some = classes.where("n > 0")
    pairs = cut(neighbours(some, node_rows), "candidate-pairs")
    keys = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    first = cut(components(cut(verified(pairs, cut(shingle_sets(keys, rows, classes), "shingle-sets")), "similar-links")), "similar-first")
    active = cut(moved_to(some.select("cid", F.col("cid").alias("root"), "fp", "fp2", "n"), first), "similar-active")
    hits = cut(unsettled(active, node_rows), "unsettled")
    found = settled(hits, shingle_sets(hits.select("cid").distinct(), rows, classes))
    second = cut(components(cut(found, "settled-links")), "similar-second")
    members = cut(moved_to(first.unionByName(second.join(first.select("node"), "node", "left_anti")), second), "similar-members")
    in_group = members.join(classes.select("cid", "rep"), F.col("node") == F.col("cid")).groupBy("root").agg(F.min("rep").alias("keep"))
    alone = classes.join(members.select("node"), F.col("cid") == F.col("node"), "left_anti")
    return rows, in_group.select("keep.doc_id", "keep.thash").unionByName(alone.select("rep.doc_id", "rep.thash"))


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, all columns kept: the one of least id (then text hash). Full repeats of a row stay once.

    Null and empty texts are alike among each other only; texts are read whole; an empty table gives an empty result; no other
    column matters, whatever its name.
    """
    rows, stay = groups(documents, id_col, text_col)
    times = rows.groupBy("doc_id", "thash").agg(F.count("*").alias("_times"))
    stay = stay.select(F.col("doc_id").alias("_doc"), F.col("thash").alias("_thash"))
    stay = cut(stay.join(times, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_thash") == F.col("thash"))).select("_doc", "_thash", "_times"), "stay")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    packed = documents.select(F.struct(*columns).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"))
    left = packed.join(stay, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_h") == F.col("_thash")))
    once = left.where("_times = 1").select("_row.*")
    again = left.where("_times > 1").dropDuplicates(["_doc", "_thash"]).select("_row.*")
    return once.unionByName(again)
