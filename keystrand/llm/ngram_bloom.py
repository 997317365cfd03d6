"""Language-model scoring with a log-frequency Bloom filter.

Texts are read and split once, into chunks: the codes of a bounded number of tokens, packed, with the hashes of the chunk's
distinct tokens. Training counts every token, then every pair of neighbours, once or more often. Token counts stay exact. Pair
counts are quantised to powers of two; a pair of level q goes into the filter q times, as (pair, 1) to (pair, q), so a count
comes back by probing level after level until one misses. Pairs meet in groups by their hash; a group adds up its counts and
builds its segment of the filter, with BITS_PER_ENTRY bits for every entry. No segment leaves its group: a chunk sends each group
the distinct pairs it asks about and gets their levels back, so what a task holds is bounded by a chunk or a group, at any size
of the filter. A token's probability mixes the filter's pair estimate with the exact add-one unigram; how much, by the
predecessor's count, is fitted on all training pairs with one occurrence taken out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import cut, discard

#: Exact token counts that are broadcast, the largest ones (12 bytes each); the others are joined by token.
MAX_BROADCAST_TOKENS = 8_000_000
#: Bits for each entry, bound of a part of the filter that is looked at as one (128 MB), and bits of an entry, all in one word.
BITS_PER_ENTRY = 16
MAX_PART_BITS = 1 << 30
PROBES = 4
#: Training tokens whose pairs meet in a group, about.
GROUP_TOKENS = 500_000
MAX_LEVEL = 62
#: Tokens of a chunk, about, and its distinct tokens: a chunk ends with the text that reaches either.
CHUNK_TOKENS = 1_500_000
CHUNK_TYPES = 250_000
BUCKETS = 32
#: Weights tried (never 0: a pair that was seen always counts), and the bins (STEPS for each doubling) of the ratio of both
#: estimates by which their gain is added up.
GRID = np.linspace(0.02, 0.98, 25)
STEPS, LOW, HIGH = 16, -24, 40
BINS = (HIGH - LOW) * STEPS + 1

END = b"\n</s>"  # no word has white space in it
BEGIN = np.uint64(0x9AE16A3B2F90404F)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def hash_of(token: bytes) -> int:
    return xxh64_intdigest(token, 9)


def tokens_of(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z (bytes do just that, and split at \\x20 \\x09-\\x0D alone), then the end."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hashes(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of (predecessor, token) for every token of texts that begin at `starts`."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts] = BEGIN
    return scrambled(before * GOLD + h)


class Codes(dict):
    """Numbers of tokens in the order they are first asked for; `fresh` are those since it was last emptied."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, token: bytes) -> int:
        self[token] = code = len(self)
        self.fresh.append(token)
        return code


def packed(x: np.ndarray) -> bytes:
    """The low five bytes of each number: with the group's bits above them one collision in 10^5 pairs at 10^9 pairs."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def group_of(pair: np.ndarray, groups: int) -> np.ndarray:
    """Group of a pair, by its highest bits; groups is a power of two and more than one."""
    return (pair >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64)


def spots(key: np.ndarray, group: np.ndarray | int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each pair in its group's segment of `words` words. Level q lies in the q-th word behind it, so
    the probes of a pair go through neighbouring memory."""
    base = scrambled((key & np.uint64((1 << 40) - 1)) + np.uint64(1 << 40) * np.asarray(group, np.uint64))
    return base, ((base >> np.uint64(32)) * np.asarray(words, np.uint64)) >> np.uint64(32)


def masks(base: np.ndarray, level: int) -> np.ndarray:
    """The PROBES bits of a pair's entry of a level within its word."""
    mixed = scrambled(base + np.uint64(level * int(GOLD) % (1 << 64)))
    out = np.uint64(1) << (mixed & np.uint64(63))
    for probe in range(1, PROBES):
        out |= np.uint64(1) << ((mixed >> np.uint64(6 * probe)) & np.uint64(63))
    return out


@dataclass
class Filter:
    """Segments of the log-frequency Bloom filter, of groups `first` and following: sizes in words, and the words."""

    groups: int
    first: int
    sizes: np.ndarray
    words: np.ndarray

    def mine(self, pair: np.ndarray) -> np.ndarray:
        group = group_of(pair, self.groups)
        return (group >= self.first) & (group < self.first + len(self.sizes))

    def levels(self, pair: np.ndarray) -> np.ndarray:
        """Level of each pair of the part's groups, 0 if it isn't there: probes go up until one misses."""
        out = np.zeros(len(pair), np.int64)
        group = group_of(pair, self.groups)
        size, start = self.sizes[group - self.first], (np.cumsum(self.sizes) - self.sizes)[group - self.first]
        base, word = spots(pair, group, size)
        word, alive = word.astype(np.int64), np.flatnonzero(size > 0)
        base, word, size, start = (x[alive] for x in (base, word, size, start))
        for level in range(1, MAX_LEVEL):
            mask = masks(base, level)
            hit = (self.words[start + (word + level) % size] & mask) == mask
            alive, base, word, size, start = (x[hit] for x in (alive, base, word, size, start))
            if not len(alive):
                break
            out[alive] = level
        return out


def level_of(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1, 2 from 2 on, 3 from 4 on and so forth."""
    return np.frexp(np.asarray(count, np.float64))[1].astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """Least count of a level, so that no context's estimates add up to more than 1; 0 for level 0."""
    return np.where(level > 0, 2.0 ** (level - 1.0), 0.0)


def segment(key: np.ndarray, group: int, level: np.ndarray) -> np.ndarray:
    """Words of a group's segment."""
    size = math.ceil(int(level.sum()) * BITS_PER_ENTRY / 64)
    part = np.zeros(size, np.uint64)
    base, word = spots(key, group, size)
    word = word.astype(np.int64)
    for q in range(1, int(level.max(initial=0)) + 1):
        base, word, level = base[level >= q], word[level >= q], level[level >= q]
        np.bitwise_or.at(part, (word + q) % size, masks(base, q))
    return part


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers under 2^32, byte by byte of all of them, compressed."""
    return _ZSTD.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(_ZSTD.decompress(data, 4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel()


_ZSTD = pa.Codec("zstd", compression_level=1)


def _row(documents: DataFrame, text_col: str) -> Column:
    """All columns but the text as one."""
    return F.struct(*[F.col(f"`{f.name}`") for f in documents.schema.fields if f.name != text_col], F.lit(0).alias("_pad")).alias("_row")


def encode(documents: DataFrame, text_col: str = "text", train: Column | None = None) -> DataFrame:
    """Chunks of whole texts: (chunk, rows, n_rows, sizes, train, n, codes, hashes).

    rows: all columns but the text; sizes: tokens of each text; train: whether it belongs to the training texts (all, if it isn't
    given); codes: n tokens as places in hashes, the chunk's distinct ones.
    """
    flag = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    rows = documents.select(_row(documents, text_col), F.col(f"`{text_col}`").alias("text"), flag.alias("train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, chunk = TaskContext.get().partitionId() << 32, 0
        codes, held, kept, flags, size = Codes(), [], [], [], 0

        def out() -> pa.RecordBatch:
            hashes = np.fromiter(map(hash_of, codes.fresh), np.uint64, len(codes.fresh))
            table = pa.Table.from_batches(kept)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            values = (first + chunk, sink.getvalue().to_pybytes(), len(held), squeezed(np.array([len(x) for x in held])), np.concatenate(flags).tobytes(), size, squeezed(np.concatenate(held)), hashes.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, CHUNK_TYPES_OF, strict=True)], names=CHUNK_COLUMNS)

        for batch in batches:
            texts, of = batch.column(1), pa.RecordBatch.from_arrays([batch.column(0)], names=["_row"])
            flagged = np.asarray(batch.column(2)).astype(np.uint8)
            begin = 0
            for at in range(len(texts)):
                words = tokens_of(texts[at].as_py())
                held.append(np.fromiter(map(codes.__getitem__, words), np.uint32, len(words)))
                size += len(words)
                if size >= CHUNK_TOKENS or len(codes) >= CHUNK_TYPES or at == len(texts) - 1:
                    kept.append(of.slice(begin, at + 1 - begin))
                    flags.append(flagged[begin : at + 1])
                    begin = at + 1
                if size >= CHUNK_TOKENS or len(codes) >= CHUNK_TYPES:
                    yield out()
                    codes, held, kept, flags, size, chunk = Codes(), [], [], [], 0, chunk + 1
        if held:
            yield out()

    return cut(rows.mapInArrow(run, CHUNK_SCHEMA), "lm-chunks")


CHUNK_SCHEMA = "chunk bigint, rows binary, n_rows bigint, sizes binary, train binary, n bigint, codes binary, hashes binary"
CHUNK_COLUMNS = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
CHUNK_TYPES_OF = [pa.int64() if c.endswith("bigint") else pa.binary() for c in CHUNK_SCHEMA.split(", ")]


@dataclass
class Chunk:
    """A chunk's texts: tokens of each and whether it's for training; the tokens' codes, and by code their hashes."""

    at: int
    sizes: np.ndarray
    train: np.ndarray
    codes: np.ndarray
    hashes: np.ndarray
    known: tuple[np.ndarray, np.ndarray] | None = None

    def counts(self, model: Model) -> np.ndarray:
        """Exact training counts by code: the broadcast ones, and of the others those that were joined."""
        found = model.unigram(self.hashes)
        if self.known is not None and len(self.known[0]):
            hashes, counts = self.known
            order = np.argsort(hashes)
            at = np.minimum(np.searchsorted(hashes, self.hashes, sorter=order), len(hashes) - 1)
            found = np.where(hashes[order[at]] == self.hashes, counts[order[at]], found)
        return found

    def training(self) -> Chunk:
        if self.train.all():
            return self
        return Chunk(self.at, self.sizes[self.train], self.train[self.train], self.codes[np.repeat(self.train, self.sizes)], self.hashes, self.known)

    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct pair hashes, one place of each, order of all places by pair). Which of equal pairs stands for them
        doesn't matter, they have the same tokens."""
        pair = pair_hashes(self.hashes[self.codes], self.starts()) if len(self.codes) else np.zeros(0, np.uint64)
        order = np.argsort(pair)
        pair = pair[order]
        first = np.flatnonzero(firsts(pair))
        return pair[first], first, order


def firsts(x: np.ndarray) -> np.ndarray:
    """Where a sorted array's runs begin."""
    return np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, bool)


def chunks_of(batch: pa.RecordBatch | pa.Table) -> Iterator[Chunk]:
    """The chunks of a batch of encode(), with the counts that were joined if there are any."""
    col = {name: batch.column(name) for name in batch.schema.names}
    get = lambda name, r: col[name][r].as_py()
    for r in range(batch.num_rows):
        n, n_rows = get("n", r), get("n_rows", r)
        known = None
        if "hs" in col and col["hs"][r].is_valid:
            known = np.asarray(col["hs"][r].values, np.int64).view(np.uint64), np.asarray(col["cs"][r].values, np.int64)
        yield Chunk(get("chunk", r), unsqueezed(get("sizes", r), n_rows).astype(np.int64), np.frombuffer(get("train", r), bool), unsqueezed(get("codes", r), n), np.frombuffer(get("hashes", r), np.uint64), known)


def _freed(df: DataFrame, name: str) -> DataFrame:
    """cut(), and the files of its shuffles are deleted when it's written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return cut(df, name)
    finally:
        conf.set(key, before)


def token_counts(encoded: DataFrame) -> DataFrame:
    """(h, n): hashes of tokens with their exact training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks_of(batch):
                total = np.bincount(chunk.training().codes, minlength=len(chunk.hashes))
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(chunk.hashes[some].view(np.int64)), pa.array(total[some])], names=["h", "n"])

    return encoded.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """total: training tokens; types: distinct ones; unigrams: sorted hashes and counts of the tokens that stand `least` times or
    oftener, the others are joined; groups of the pairs, and where the filter's parts begin among them."""

    total: int
    types: int
    weights: np.ndarray
    hashes: np.ndarray
    unigrams: np.ndarray
    least: int = 1
    groups: int = 2
    starts: tuple[int, ...] = (0,)

    def unigram(self, h: np.ndarray) -> np.ndarray:
        """Exact training counts of token hashes, 0 for those that are joined."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.unigrams[at], 0).astype(np.int64)


@dataclass
class Trained:
    """A model with its tables: token counts (h, n) and the filter's segments (grp, size, words)."""

    model: Model
    tokens: DataFrame
    segments: DataFrame


def bucket_of(before: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(before + 1.0).astype(np.int64), BUCKETS - 1)


def ratio_bin(log_ratio: np.ndarray) -> np.ndarray:
    """Bin, from 1 on, of the logarithm in STEPS of the ratio of the pair's estimate to the unigram's; 0 is for a ratio of 0."""
    return (1 + np.clip(log_ratio - LOW * STEPS, 0, BINS - 1)).astype(np.int64)


def built_segments(encoded: DataFrame, model: Model) -> DataFrame:
    """(grp, size, words, at, n): each group's segment, and by bucket and ratio bin (at) how many occurrences (n) its pairs have.

    Tasks hand on packed partial counts by group: pairs (5 bytes), counts (4), the logarithm of what one count of the pair adds to
    the ratio of both estimates (2) and the predecessor's bucket (1).
    """
    groups = model.groups
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    names = ["grp", "pairs", "count", "unit", "bucket"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for chunk in chunks_of(batch):
                part = chunk.training()
                pair, first, order = part.pairs()
                n = np.diff(np.append(first, len(order)))
                single, before = _unigram_parts(m, part.counts(m), part.codes, part.starts(), order[first])
                unit = np.where(before > 1, np.round(-np.log2(np.maximum(before - 1, 1) * single) * STEPS), -(1 << 14)).astype(np.int16)
                bucket = bucket_of(before).astype(np.uint8)
                group, cuts = _by_group(pair, groups)
                cut_at = lambda x, of, cuts=cuts: pa.array([of(x[a:b]) for a, b in cuts], pa.binary())
                raw = np.ndarray.tobytes
                yield pa.RecordBatch.from_arrays([pa.array(group), cut_at(pair, packed), cut_at(n.astype(np.uint32), raw), cut_at(unit, raw), cut_at(bucket, raw)], names=names)

    def add(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        blob = {c: b"".join(table.column(c).to_pylist()) for c in names[1:]}
        key, n = unpacked(blob["pairs"]), np.frombuffer(blob["count"], np.uint32).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, n, first = key[starts], np.add.reduceat(n[order], starts), order[starts]
        unit, bucket = np.frombuffer(blob["unit"], np.int16)[first], np.frombuffer(blob["bucket"], np.uint8)[first].astype(np.int64)
        level = level_of(n)
        words = segment(key, group, level)
        less = count_of(level) - 1  # one occurrence is taken out
        known = (less > 0) & (unit > -(1 << 14))
        at = bucket * (BINS + 1)
        at[known] += ratio_bin(unit[known] + np.round(np.log2(less[known]) * STEPS))
        at, which = np.unique(at, return_inverse=True)
        total = np.bincount(which, n, len(at)).astype(np.int64)
        return pa.table({"grp": pa.array([group], pa.int64()), "size": pa.array([len(words)], pa.int64()), "words": pa.array([words.tobytes()], pa.binary()), "at": pa.array([at.tolist()], pa.list_(pa.int64())), "n": pa.array([total.tolist()], pa.list_(pa.int64()))})

    partial = encoded.mapInArrow(run, "grp bigint, pairs binary, count binary, unit binary, bucket binary")
    return partial.groupBy("grp").applyInArrow(add, "grp bigint, size bigint, words binary, at array<bigint>, n array<bigint>")


def _unigrams(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their counts of rows (h, n), packed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(c).tobytes()], pa.binary()) for c in batch.columns], names=["h", "n"])

    blobs = [(np.frombuffer(r["h"], np.uint64), np.frombuffer(r["n"], np.int64)) for r in tokens.select("h", "n").mapInArrow(run, "h binary, n binary").toLocalIterator()]
    hashes, numbers = (np.concatenate([np.zeros(0, t), *(b[k] for b in blobs)]) for k, t in enumerate((np.uint64, np.int64)))
    order = np.argsort(hashes)
    return hashes[order], numbers[order].astype(np.uint32 if numbers.max(initial=0) < 1 << 32 else np.uint64)


def fit(train: DataFrame, text_col: str = "text", max_broadcast_tokens: int = MAX_BROADCAST_TOKENS, max_part_bits: int = MAX_PART_BITS, group_tokens: int = GROUP_TOKENS) -> Trained:
    """The model of all texts of `train`. No pair is left out and the filter is as large as its entries need."""
    trained, counted = _fit(encode(train.select(F.col(text_col).alias("text"))), max_broadcast_tokens, max_part_bits, group_tokens)
    discard(counted)
    return trained


def _fit(encoded: DataFrame, max_broadcast_tokens: int = MAX_BROADCAST_TOKENS, max_part_bits: int = MAX_PART_BITS, group_tokens: int = GROUP_TOKENS) -> tuple[Trained, DataFrame]:
    """The model of the training texts of encode(), and its chunks with the counts they need."""
    tokens = _freed(token_counts(encoded), "lm-tokens")
    total, types = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = 1
    if types > max_broadcast_tokens:  # the largest counts that there is room for
        level = F.ceil(F.log2(F.col("n") + 1))
        held, least = 0, 1 << 62
        for r in tokens.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
            held += r["count"]
            if held > max_broadcast_tokens:
                break
            least = 1 << (r["level"] - 1)
    hashes, numbers = _unigrams(tokens.where(F.col("n") >= least))
    groups = 1 << max(1, math.ceil(math.log2(max(1, total / group_tokens))))
    model = Model(total, types, np.full(BUCKETS, GRID[0]), hashes, numbers, least, groups)
    counted = _with_counts(encoded, tokens, model)
    segments = _freed(built_segments(counted, model), "lm-segments")
    sizes = np.zeros(groups, np.int64)
    for r in segments.select("grp", "size").collect():  # one number for each GROUP_TOKENS tokens
        sizes[r["grp"]] = r["size"]
    starts, held = [0], 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + 64 * size > max_part_bits:
            starts.append(k)
            held = 0
        held += 64 * size
    model.starts = tuple(starts)
    table = np.zeros((BUCKETS, BINS + 1))
    pairs = segments.select(F.explode(F.arrays_zip("at", "n")).alias("x"))
    for r in pairs.groupBy("x.at").agg(F.sum("x.n").alias("n")).collect():  # at most as many as the table has
        table[divmod(r["at"], BINS + 1)] = r["n"]
    model.weights = best_weights(table)
    return Trained(model, tokens, segments.select("grp", "size", "words")), counted


def filter_part(trained: Trained, part: int) -> Filter:
    """One part of the filter; its segments go through the driver into a broadcast."""
    model = trained.model
    first = model.starts[part]
    last = model.starts[part + 1] if part + 1 < len(model.starts) else model.groups
    rows = trained.segments.where(F.col("grp").between(first, last - 1))
    sizes = np.zeros(last - first, np.int64)
    for r in rows.select("grp", "size").collect():
        sizes[r["grp"] - first] = r["size"]
    ends, words = np.cumsum(sizes), np.zeros(int(sizes.sum()), np.uint64)
    for r in rows.toLocalIterator():
        end = int(ends[r["grp"] - first])
        words[end - r["size"] : end] = np.frombuffer(r["words"], np.uint64)
    return Filter(model.groups, first, sizes, words)


def _unigram_parts(model: Model, c: np.ndarray, *at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unigram probability, predecessor's count) of tokens.

    Either c has the tokens' counts and `at` the starts of the texts, or c has the counts by code and `at` the tokens' codes, the
    starts of the texts and the places that are asked for.
    """
    if len(at) == 1:
        codes, starts, places = np.arange(len(c)), at[0], np.arange(len(c))
    else:
        codes, starts, places = at
    before = c[codes[places - 1]].astype(np.float64) if len(places) else np.zeros(0)
    begins = np.zeros(len(codes), bool)
    begins[starts] = True
    before[begins[places]] = 0
    return (c[codes[places]] + 1.0) / (model.total + model.types + 1.0), before


def _by_group(pair: np.ndarray, groups: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Groups of sorted pairs, with the range of each one's pairs."""
    group = group_of(pair, groups)
    starts = np.flatnonzero(firsts(group))
    return group[starts], list(zip(starts.tolist(), [*starts[1:].tolist(), len(pair)], strict=False))


def _with_counts(encoded: DataFrame, tokens: DataFrame, model: Model) -> DataFrame:
    """Chunks with the counts (hs, cs) of those of their tokens that aren't broadcast, in place of the chunks; as they are if all are."""
    if model.least <= 1:
        return encoded
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at, hashes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.frombuffer(hashes.as_py(), np.uint64)
                h = h[m.unigram(h) == 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), at)), pa.array(h.view(np.int64))], names=["_of", "h"])

    asked = encoded.select("chunk", "hashes").mapInArrow(ask, "_of bigint, h bigint")
    found = asked.join(tokens.where(F.col("n") < model.least), "h").groupBy("_of").agg(F.collect_list(F.struct("h", "n")).alias("known"))
    joined = encoded.join(found, F.col("chunk") == F.col("_of"), "left").select(*CHUNK_COLUMNS, F.col("known.h").alias("hs"), F.col("known.n").alias("cs"))
    counted = _freed(joined, "lm-counted")
    discard(encoded)
    return counted


def best_weights(table: np.ndarray) -> np.ndarray:
    """Weight of greatest likelihood for each row of a BUCKETS x (BINS + 1) table of counts by ratio_bin()."""
    ratio = np.concatenate([[0.0], 2.0 ** (LOW + np.arange(BINS) / STEPS)])
    gain = np.log((1 - GRID)[:, None] + GRID[:, None] * ratio[None, :])  # the unigram's own logarithm is the same for all weights
    return GRID[np.argmax(table @ gain.T, axis=1)]


def _levels(chunks: DataFrame, trained: Trained) -> DataFrame:
    """(chunk, grp, levels): the levels of a chunk's distinct pairs of a group, in the order of their hashes (one byte each)."""
    groups = trained.model.groups

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks_of(batch):
                pair = chunk.pairs()[0]
                group, cuts = _by_group(pair, groups)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(np.full(len(group), chunk.at)), pa.array([packed(pair[a:b]) for a, b in cuts], pa.binary())], names=["grp", "chunk", "pairs"])

    def answer(asked: pa.Table, segment: pa.Table) -> pa.Table:
        pairs = asked.column("pairs").to_pylist()
        if segment.num_rows and pairs:
            group = segment.column("grp")[0].as_py()
            words = np.frombuffer(segment.column("words")[0].as_py(), np.uint64)
            top = np.uint64(group << (64 - groups.bit_length() + 1))
            found = Filter(groups, group, np.array([len(words)]), words).levels(unpacked(b"".join(pairs)) | top).astype(np.uint8).tobytes()
        else:
            found = bytes(sum(map(len, pairs)) // 5)
        ends = np.cumsum([len(p) // 5 for p in pairs], dtype=np.int64).tolist()
        levels = [found[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return pa.table({"chunk": asked.column("chunk"), "grp": asked.column("grp"), "levels": pa.array(levels, pa.binary())})

    asked = chunks.mapInArrow(ask, "grp bigint, chunk bigint, pairs binary").groupBy("grp")
    return asked.cogroup(trained.segments.groupBy("grp")).applyInArrow(answer, "chunk bigint, grp bigint, levels binary")


def score(documents: DataFrame, trained: Trained, text_col: str = "text") -> DataFrame:
    """All columns of `documents` but the text, plus n_tokens, n_known, train_tokens, base_score and score.

    base_score is the exact add-one unigram log10 probability, score the mixture's. Null and empty texts have the end token
    alone. Texts are read whole; repeated rows score alike; an empty table gives an empty result; own columns replace columns
    of the same name.
    """
    rows = documents.drop(*OWN)
    return _score(_with_counts(encode(rows, text_col), trained.tokens, trained.model), trained, rows.select(_row(rows, text_col)).schema.fields)


def fit_and_score(documents: DataFrame, train: Column, text_col: str = "text", **options: int) -> DataFrame:
    """score() of all documents by the fit() of those for which `train` holds; the texts are read once for both."""
    rows = documents.drop(*OWN)
    trained, counted = _fit(encode(rows, text_col, train), **options)
    return _score(counted, trained, rows.select(_row(rows, text_col)).schema.fields)


OWN = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def _score(chunks: DataFrame, trained: Trained, row: list[T.StructField]) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(trained.model)
    levels = _freed(_levels(chunks, trained), "lm-levels")

    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        m, chunk = shared.value, next(chunks_of(texts))
        order = np.argsort(np.asarray(found.column("grp")))
        blobs = found.column("levels").to_pylist()
        level = np.frombuffer(b"".join([blobs[k] for k in order.tolist()]), np.uint8)
        counts = chunk.counts(m)
        pair, first, order = chunk.pairs()
        single, before = _unigram_parts(m, counts, chunk.codes, chunk.starts(), order[first])
        weight = np.where(before > 0, m.weights[bucket_of(before)], 0.0)
        p2 = np.minimum(np.divide(count_of(level), before, out=np.zeros(len(pair)), where=before > 0), 1.0)
        mixture = np.empty(len(order))
        mixture[order] = np.repeat(np.log10(weight * p2 + (1 - weight) * single), np.diff(np.append(first, len(order))))
        starts = chunk.starts()
        base = np.add.reduceat(np.log10((counts + 1.0) / (m.total + m.types + 1.0))[chunk.codes], starts)
        known = np.add.reduceat((counts > 0).astype(np.int64)[chunk.codes], starts)
        with pa.ipc.open_stream(texts.column("rows")[0].as_py()) as reader:
            rows = reader.read_all().column("_row")
        own = [pa.array(chunk.sizes), pa.array(known), pa.array(np.full(len(starts), m.total), pa.int64()), pa.array(base), pa.array(np.add.reduceat(mixture, starts))]
        return pa.table([rows, *own], names=["_row", *OWN])

    own = [T.StructField(c, T.LongType() if k < 3 else T.DoubleType()) for k, c in enumerate(OWN)]
    schema = T.StructType([*row, *own])
    return chunks.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(finish, schema).select("_row.*", *OWN).drop("_pad")
