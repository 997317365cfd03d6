"""SimHash near-duplicates over a hierarchical index in Gray order.

Fingerprints that differ in at most r bits agree on a masked bit pattern of some block pair, so every fingerprint goes under
the upper nodes of its masked patterns. Below such a node fingerprints are sorted by Gray rank; runs of them form nodes
that hold the bits all their members share, level by level. A pair of nodes whose shared bits already differ in more than r
places is pruned with everything below it. Upper nodes with too many members are refined by further masked patterns of the
remaining bits (again one of which must agree), so no node outgrows a task. Links found inside a node are reduced to a
spanning forest; components are joined by minimum-label hooking and shortcutting on tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, discard

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Members of an upper node above which it is refined.
NODE_ROWS = 4096
#: Members of a run below which its pairs are compared directly.
SMALL_RUN = 48
FULL = (1 << 64) - 1
#: Shingles hashed at a time.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; of the whole sequence if it is shorter; none for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \x20 \x09-\x0D only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def mixed(hashes: np.ndarray) -> np.ndarray:
    """A second, independent hash of each shingle, from its first."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with fp a signed 64-bit integer; 0 for texts without words."""
    kind = documents.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(majority(shingle_hashes(x.as_py(), shingle))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def block_masks(bits: int, blocks: int) -> list[int]:
    """Masks that split the set bits of `bits` into contiguous blocks of nearly equal size."""
    places = [i for i in range(64) if bits >> i & 1]
    cuts = [round(k * len(places) / blocks) for k in range(blocks + 1)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def first_masks(radius: int = RADIUS) -> list[int]:
    """radius + 2 blocks, any two of them: radius differing bits leave at least two blocks alike."""
    blocks = block_masks(FULL, radius + 2)
    return [a | b for a, b in combinations(blocks, 2)]


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """mask plus one of radius + 1 blocks of the other bits, at least one of which is alike in a link."""
    return [mask | more for more in block_masks(FULL & ~mask, radius + 1)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def upper_nodes(prints: DataFrame, masks: list[int], radius: int = RADIUS, node_rows: int = NODE_ROWS, value: str = "fp") -> DataFrame:
    """(mask, pattern, and the columns of `prints`): every fingerprint under the masked patterns it has.

    A node over node_rows members is replaced by the nodes of finer masks until none is left, which must end: once all but
    log2(node_rows) bits are masked a node can't have more distinct fingerprints.
    """
    spark = prints.sparkSession
    columns = prints.columns
    rows = prints.select("*", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask")).withColumn("pattern", F.col(value).bitwiseAND(F.col("mask")))
    done: list[DataFrame] = []
    while True:
        large = rows.groupBy("mask", "pattern").agg(F.count("*").alias("_n")).where(F.col("_n") > node_rows)
        found = [r["mask"] for r in large.select("mask").distinct().collect()]  # at most as many as there are masks
        if not found:
            done.append(rows)
            break
        large = cut(large.select(F.col("mask").alias("_mask"), F.col("pattern").alias("_pattern")), "large-nodes")
        same = (F.col("mask") == F.col("_mask")) & (F.col("pattern") == F.col("_pattern"))
        done.append(rows.join(large, same, "left_anti"))
        finer = spark.createDataFrame([(m, signed(f)) for m in found for f in finer_masks(m & FULL, radius)], "_of bigint, finer bigint")
        inside = rows.join(large, same, "left_semi").join(F.broadcast(finer), F.col("mask") == F.col("_of"))
        rows = cut(inside.select(*columns, F.col("finer").alias("mask"), F.col(value).bitwiseAND(F.col("finer")).alias("pattern")), "finer-nodes")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def run_pairs(x: np.ndarray, radius: int, leaf: int = 16, fan: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of fingerprints within the radius, x in Gray order: a descent over pairs of index nodes."""
    n = len(x)
    levels = [(np.arange(0, n, leaf), np.minimum(np.arange(0, n, leaf) + leaf, n))]
    while len(levels[-1][0]) > fan:
        s, e = levels[-1]
        levels.append((s[::fan], np.append(e[fan - 1 :: fan], e[-1:]) if len(e) % fan else e[fan - 1 :: fan]))
    shared = []
    for s, _ in levels:
        first = x[s]
        differs = np.bitwise_or.reduceat(x ^ np.repeat(first, np.diff(np.append(s, n))), s)
        shared.append((first, ~differs))
    top = len(levels[-1][0])
    a, b = np.triu_indices(top)
    for depth in range(len(levels) - 1, -1, -1):
        pattern, mask = shared[depth]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= radius
        a, b = a[near], b[near]
        width = fan if depth else leaf
        limit = len(levels[depth - 1][0]) if depth else n
        oa, ob = (g.ravel() for g in np.meshgrid(np.arange(width), np.arange(width), indexing="ij"))
        at, bt = [], []
        for k in range(0, len(a), 8192):
            ca, cb = (a[k : k + 8192, None] * width + oa).ravel(), (b[k : k + 8192, None] * width + ob).ravel()
            ok = (ca <= cb if depth else ca < cb) & (cb < limit) & (ca < limit)
            ca, cb = ca[ok], cb[ok]
            if not depth:
                ok = np.bitwise_count(x[ca] ^ x[cb]) <= radius
                ca, cb = ca[ok], cb[ok]
            at.append(ca)
            bt.append(cb)
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (at, bt))
    return a, b


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of consecutive rows, cut so that rows with equal first `keys` columns stay together (they come sorted)."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [np.asarray(c) for c in batch.columns]
        if held is not None:
            now = [np.concatenate([h, c]) for h, c in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        last = np.ones(len(now[0]), bool)
        for c in now[:keys]:
            last &= c == c[-1]
        at = len(last) - int(last[::-1].argmin() if not last.all() else len(last))
        if at:
            yield [c[:at] for c in now]
        held = [c[at:] for c in now]
    if held is not None and len(held[0]):
        yield held


def links(prints: DataFrame, radius: int = RADIUS, node_rows: int = NODE_ROWS, second: int | None = None) -> DataFrame:
    """(a, b): links that span every component of fingerprints (column fp) within the radius, a the first of the component
    in some index node and b another one of it.

    With `second`, rows are (cid, fp, fp2): a link also needs fp and fp2 together to differ in no more bits than that, and a
    and b are cids.
    """
    named = "fp" if second is None else "cid"
    nodes = upper_nodes(prints.select(*dict.fromkeys((named, "fp", "fp" if second is None else "fp2"))), first_masks(radius), radius, node_rows)
    dealt = nodes.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
    dealt = dealt.select("mask", "pattern", "fp", *([] if second is None else ["cid", "fp2"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mask, pattern, fp, *more in runs_of(batches, 2):
            starts = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])))
            sizes = np.diff(np.append(starts, len(fp)))
            x = fp.view(np.uint64)
            run_no = np.repeat(np.arange(len(starts)), sizes)
            order = np.lexsort((gray_rank(x), run_no))
            x = x[order]
            name = fp[order] if second is None else more[0][order]
            y = None if second is None else more[1].view(np.uint64)[order]

            def near(i: np.ndarray, j: np.ndarray, x=x, y=y) -> np.ndarray:
                apart = np.bitwise_count(x[i] ^ x[j]).astype(np.int64)
                return apart <= radius if y is None else (apart <= radius) & (apart + np.bitwise_count(y[i] ^ y[j]) <= second)

            at, bt = [], []
            small = np.repeat(sizes <= SMALL_RUN, sizes)
            for d in range(1, int(sizes[sizes <= SMALL_RUN].max(initial=1))):
                i = np.flatnonzero((run_no[d:] == run_no[:-d]) & small[d:])
                i = i[near(i, i + d)]
                at.append(i)
                bt.append(i + d)
            for s, size in zip(starts[sizes > SMALL_RUN].tolist(), sizes[sizes > SMALL_RUN].tolist(), strict=True):
                i, j = run_pairs(x[s : s + size], radius)
                ok = near(i + s, j + s)
                root = forest(size, i[ok], j[ok])  # one node at a time, or the pairs of all would add up
                j = np.flatnonzero(root != np.arange(size))
                at.append(root[j] + s)
                bt.append(j + s)
            if not at:
                continue
            root = forest(len(x), np.concatenate(at), np.concatenate(bt))
            j = np.flatnonzero(root != np.arange(len(x)))
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(name[root[j]]), pa.array(name[j])], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each component, for all nodes with a link; one row per node.

    Each round every node takes the least parent of its neighbours' parents, hooks its own parent to it and is shortcut; it
    ends when no parent changes. Rounds grow with the logarithm of the longest path.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = cut(one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    parent = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("root")), "parents")
    while True:
        to = parent.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        grand = cut(parent.join(to, F.col("root") == F.col("_node")).select("node", F.col("root").alias("parent"), F.col("_root").alias("grand")), "grand")
        near = both.join(grand.select(F.col("node").alias("v"), F.col("grand").alias("g")), "v").groupBy("u").agg(F.min("g").alias("least"))
        near = grand.join(near, F.col("node") == F.col("u")).select("node", "parent", "grand", "least")
        offers = near.select(F.explode(F.array(F.struct("node", F.least("grand", "least").alias("root")), F.struct(F.col("parent").alias("node"), F.col("least").alias("root")), F.struct(F.col("parent").alias("node"), F.col("grand").alias("root")))).alias("o")).select("o.*")
        found = cut(offers.groupBy("node").agg(F.min("root").alias("root")), "parents")
        changed = found.join(parent.withColumnRenamed("root", "_before"), "node").where(F.col("root") != F.col("_before")).limit(1).count()
        discard(grand, parent)
        parent = found
        if not changed:
            discard(both)
            return parent


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, node_rows: int = NODE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `documents`.

    Equal fingerprints are one class; classes within the radius link; the component's id is the least doc_id in it. Null and
    blank texts have fingerprint 0 and link like any other. Null ids stay and never become a component's id unless it has
    no other. Repeated rows are kept, an empty table gives an empty result, columns besides id and text don't matter.
    """
    prints = cut(fingerprints(documents, id_col, text_col, shingle), "fingerprints")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    joined = components(links(classes, radius, node_rows))
    least = joined.join(classes, F.col("node") == F.col("fp")).select("node", "root", "least_id")
    least = least.join(least.groupBy(F.col("root").alias("_root")).agg(F.min("least_id").alias("least")), F.col("root") == F.col("_root")).select("node", "least")
    of_class = cut(classes.join(least, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("least", "least_id").alias("component_id")), "components")
    return prints.join(of_class, F.col("fp") == F.col("_fp")).select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")
