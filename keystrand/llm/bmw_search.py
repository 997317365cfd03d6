"""Exact top-k search by BM25: block-max WAND per shard, merged with global statistics.

Documents are packed once into shards of bounded size: their lengths and the counts of their terms by hash. Document frequencies are
added up over all shards. Queries are taken in blocks of bounded number. For each block a shard's postings of the block's terms are
inverted, and its documents put in groups that share common words (of one language, say); the long lists of a group
stay closed there behind the maxima that they reach in each block of documents. Queries open their other lists, which gives every document
a part of its score and, with the maxima, a bound. The likeliest documents set the k-th best score; blocks whose bounds stay under
it are never read in the closed lists. The others are read for the queries of a batch that need them, in one matrix product of single
precision, and what comes near the k-th best score is scored anew, exactly. Some shards are searched before the others,
which start from the scores that are reached there. Tasks hand on their k best for each query; these are merged in two steps,
exactly, as every score is made with the global statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import cut, read_table

K = 10
K1, B = 1.2, 0.75
#: Queries in a block, documents in a shard, documents in a block of the index.
QUERY_BLOCK = 16_384
SHARD_DOCS = 8_192
BLOCK_DOCS = 8
#: Lists stay closed behind block maxima if they hold this share of the documents at least, and are among so many longest ones.
LONG_SHARE = 0.04
LONG_LISTS = 1_024
#: Groups of a shard's documents, by so many commonest terms; commonest terms by which a group's documents are put in order.
GROUPS, GROUP_TERMS, ROUNDS = 8, 192, 4
SIGNATURE = 16
#: Queries whose results are one row, queries that are looked at together, and those whose lists are opened together.
PACK, TOGETHER, FEW = 256, 256, 16
#: One shard of so many is searched before the others.
EARLY = 32
#: Relative error that a sum of single precision stays under.
SLACK = 2e-4
#: Decimals of a score: equal documents in different shards come out equal, whatever the order of their sums.
DECIMALS = 9
NO_ID = np.iinfo(np.int64).min

TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII digits and letters (A-Z lower-cased) and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class Hashes(dict):
    """Hashes of terms, computed when first asked for; emptied when there are too many."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[term] = h = xxh64_intdigest(term, 17)
        return h

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, counts) of a text's distinct terms."""
        words = terms_of(text)
        one, n = np.unique(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)), return_counts=True)
        return one, n.astype(np.uint32)


@dataclass
class Queries:
    """A block of queries: ids; the sorted hashes of all their terms; each query's terms as places in it
    (terms[starts[i]:starts[i+1]]) with how often each stands there. Queries with the same common words stand together."""

    ids: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    times: np.ndarray


def packed_queries(asked: DataFrame) -> DataFrame:
    """(q, words, times): hashes and counts of the terms of rows (q, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Hashes()
        for batch in batches:
            found = [made.counted(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.tobytes() for w, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())], names=["q", "words", "times"])

    return asked.select("q", "text").mapInArrow(run, "q bigint, words binary, times binary")


def query_block(rows: pa.Table) -> Queries:
    words = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("words")]
    times = [np.frombuffer(x.as_py(), np.uint32) for x in rows.column("times")]
    known, terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]), return_inverse=True)
    terms, starts = terms.astype(np.int32), np.cumsum([0, *map(len, words)])
    ids, sizes = np.asarray(rows.column("q"), np.int64), np.diff(starts)
    order = np.argsort(signatures(terms, np.repeat(np.arange(len(ids)), sizes), len(ids)), kind="stable")
    at = spread(starts[:-1][order], sizes[order])
    times = np.concatenate([np.zeros(0, np.uint32), *times])
    return Queries(ids[order], known, np.cumsum([0, *sizes[order]]), terms[at], times[at])


def signatures(term: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which of the SIGNATURE commonest terms each of n texts has, as bits, the commonest highest."""
    kind = np.zeros(n, np.int64)
    for bit, t in enumerate(np.argsort(-np.bincount(term, minlength=1), kind="stable")[:SIGNATURE].tolist()):
        kind[doc[term == t]] |= 1 << (SIGNATURE - 1 - bit)
    return kind


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of ranges that begin at `first` and have so many."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def shards(documents: DataFrame, id_col: str, text_col: str, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Packed shards of shard_docs documents and a quarter more at most, numbered (lot): ids, lengths, numbers of distinct terms, the shard's sorted term hashes,
    and for every posting, document by document, its term's place among them and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, lot = Hashes(), TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            words, terms = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
            count = np.concatenate([h[2] for h in held])
            lengths = [int(h[2].sum()) for h in held]
            cols = (np.array([h[0] for h in held], np.int64), np.array(lengths, np.int64), np.array([len(h[1]) for h in held], np.int32), words, terms.astype(np.int32), count)
            return pa.RecordBatch.from_arrays([pa.array([lot], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([sum(lengths)], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names=["lot", "n", "length", *BLOBS])

        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(NO_ID))
            for i, x in zip(ids.tolist(), batch.column(1), strict=True):
                held.append((i, *made.counted(x.as_py())))
                if len(held) == shard_docs + shard_docs // 4:  # what is left over isn't a shard of its own if it's small
                    held, rest = held[:shard_docs], held[shard_docs:]
                    yield packed()
                    held, lot = rest, lot + 1
        if held:
            yield packed()

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"lot bigint, n bigint, length bigint, {', '.join(f'{b} binary' for b in BLOBS)}")


BLOBS = ("ids", "lengths", "sizes", "words", "terms", "counts")
KINDS = (np.int64, np.int64, np.int32, np.uint64, np.int32, np.uint32)


def frequencies(packed: DataFrame) -> DataFrame:
    """(h, df): in how many documents each term stands, added up over the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, terms in zip(*batch.columns, strict=True):
                h = np.frombuffer(words.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.bincount(np.frombuffer(terms.as_py(), np.int32), minlength=len(h)))], names=["h", "df"])

    return packed.select("words", "terms").mapInArrow(run, "h bigint, df bigint").groupBy("h").agg(F.sum("df").alias("df"))


def known_frequencies(df: DataFrame, block: Queries) -> np.ndarray:
    """Document frequency of each of the block's terms: at most as many rows as it has terms come to the driver."""
    spark = df.sparkSession
    wanted = spark.createDataFrame(pa.table({"h": block.words.view(np.int64)}))
    found = df.join(F.broadcast(wanted), "h").select("h", "df").toArrow()
    out = np.zeros(len(block.words))
    out[np.searchsorted(block.words, np.asarray(found.column("h"), np.int64).view(np.uint64))] = np.asarray(found.column("df"))
    return out


@dataclass
class Group:
    """Alike documents of an Index: where their places begin, and in how many blocks; for each of the index's closed terms which
    column it has here (-1: it's open); columns' impacts by document, and their block maxima."""

    begin: int
    n_blocks: int
    column: np.ndarray
    long: np.ndarray
    maxima: np.ndarray


class Index:
    """One shard inverted for a block's terms: lists of (document, impact) by term, and by group of alike documents the impacts
    and block maxima of its long lists, which are closed there.

    A group's documents have the places begin to begin + BLOCK_DOCS * n_blocks, place begin + p in its block p modulo n_blocks; places
    that are left over have the id NO_ID and no terms. blocks_read and blocks count, over all queries, the blocks of documents whose
    bounds reached the k-th best score, and all blocks.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, words: np.ndarray, terms: np.ndarray, counts: np.ndarray, known: np.ndarray, idf: np.ndarray, mean: float):
        term = _placed(words, known)[terms]
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        some = term >= 0
        term, doc, tf = term[some], doc[some], counts[some]
        group = alike(doc, term, len(ids))
        order = np.lexsort((ids, lengths, signatures(term, doc, len(ids)), group))  # documents with the same common words and of like length share blocks: tighter maxima
        place, cuts, self.n = np.empty(len(ids), np.int32), [], 0
        starts = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)) if len(ids) else np.zeros(0, np.int64)
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=False):
            n_blocks, j = math.ceil((z - a) / BLOCK_DOCS), np.arange(z - a)
            place[order[a:z]] = self.n + j % BLOCK_DOCS * n_blocks + j // BLOCK_DOCS
            cuts.append((self.n, n_blocks, z - a))
            self.n += n_blocks * BLOCK_DOCS
        self.ids = np.full(self.n, NO_ID)
        self.ids[place] = ids
        norm = K1 * (1 - B + B * lengths / max(mean, 1e-9))
        #: Documents' terms and their counts, one document after the other.
        self.term, self.tf, self.idf = term, tf, idf
        size, self.size, self.first, self.norm = np.bincount(doc, minlength=len(ids)), np.zeros(self.n, np.int64), np.zeros(self.n, np.int64), np.ones(self.n)
        self.size[place], self.first[place], self.norm[place] = size, np.cumsum(size) - size, norm
        impact = norm.astype(np.float32)[doc]
        impact += tf
        np.divide(tf, impact, out=impact, dtype=np.float32, casting="same_kind")
        impact *= ((K1 + 1) * idf).astype(np.float32)[term]
        closed = np.zeros(len(term), bool)
        chosen, self.groups, of = [], [], group.astype(np.int8)[doc] if len(ids) else doc
        for (begin, n_blocks, n), g in zip(cuts, group[order[starts]].tolist(), strict=True):
            mine = np.flatnonzero(of == g)
            length = np.bincount(term[mine], minlength=len(idf))
            longest = np.flatnonzero(length >= max(2, LONG_SHARE * n))
            longest = longest[np.argsort(-length[longest], kind="stable")[:LONG_LISTS]]
            slot = np.full(len(idf), -1, np.int32)
            slot[longest] = np.arange(len(longest))
            slot = slot[term[mine]]
            mine, slot = mine[slot >= 0], slot[slot >= 0]
            closed[mine] = True
            long = np.zeros((n_blocks * BLOCK_DOCS, len(longest)), np.float32)
            long[place[doc[mine]] - begin, slot] = impact[mine]
            chosen.append(longest)
            self.groups.append(Group(begin, n_blocks, longest, long, long.reshape(BLOCK_DOCS, n_blocks, -1).max(axis=0)))
        #: Terms that are closed somewhere, by term its number among them.
        every = np.unique(np.concatenate([np.zeros(0, np.int64), *chosen]))
        self.number = np.full(len(idf), len(every), np.int32)
        self.number[every] = np.arange(len(every))
        for one, longest in zip(self.groups, chosen, strict=True):
            one.column = np.full(len(every) + 1, -1, np.int32)
            one.column[self.number[longest]] = np.arange(len(longest))
        opened = np.flatnonzero(~closed)
        opened = opened[np.argsort(term[opened])]
        #: Postings of open lists, place and impact side by side.
        self.posting = np.empty((len(opened), 2), np.uint32)
        self.posting[:, 0], self.posting[:, 1] = place[doc[opened]], impact[opened].view(np.uint32)
        self.posting = self.posting.view(np.uint64).ravel()
        self.starts = np.append(0, np.cumsum(np.bincount(term[opened], minlength=len(idf)))).astype(np.int32)
        self.n_blocks = sum(g.n_blocks for g in self.groups)
        self.asked = np.zeros(len(idf))
        self.blocks_read, self.blocks = 0, 0

    def bounds(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """For some queries at once: their weights of the closed lists, and what these add at most to a document of each block (both
        group after group)."""
        number = self.number[np.concatenate([q[0] for q in queries])]
        row, times = np.repeat(np.arange(len(queries)), [len(q[0]) for q in queries]), np.concatenate([q[1] for q in queries])
        weights, most = [np.zeros((len(queries), 0), np.float32)], [np.zeros((len(queries), 0), np.float32)]
        for g in self.groups:
            column, weight = g.column[number], np.zeros((len(queries), g.long.shape[1]), np.float32)
            here = np.flatnonzero(column >= 0)
            weight[row[here], column[here]] = times[here]
            weights.append(weight)
            most.append(weight @ g.maxima.T)
        return np.concatenate(weights, axis=1), np.concatenate(most, axis=1)

    def top(self, terms: np.ndarray, times: np.ndarray, weight: np.ndarray, most: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, places) of the k best documents of the shard that score above 0 and at least `least`.

        weight and most are the query's rows of bounds().
        """
        return self.several([(terms, times)], weight[None], most[None], k, np.array([least]))[0]

    def several(self, queries: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, most: np.ndarray, k: int, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """top() of some queries, each with its own `least`."""
        opened = self._opened(queries)
        low = np.array(least, np.float64)
        for i in np.flatnonzero(low <= 0).tolist():  # the likeliest documents set what the others have to reach
            each, at = opened[i].copy(), 0
            for g in self.groups:
                each[g.begin : g.begin + BLOCK_DOCS * g.n_blocks] += np.tile(most[i, at : at + g.n_blocks], BLOCK_DOCS)
                at += g.n_blocks
            done = np.zeros(0)
            for step in (2 * k, 4 * k):
                now = np.argpartition(each, -step)[-step:] if self.n > step else np.arange(self.n)
                now = now[each[now] >= low[i] * (1 - SLACK)]
                done = np.append(done, self._exact(*queries[i], now))
                each[now] = -1
                if len(done) >= k:
                    low[i] = np.partition(done, -k)[-k]
        low = (low * (1 - SLACK)).astype(np.float32)
        self.blocks += len(queries) * self.n_blocks
        near: list[list[np.ndarray]] = [[] for _ in queries]
        at = column = 0
        for g in self.groups:
            part = opened[:, g.begin : g.begin + BLOCK_DOCS * g.n_blocks]
            bound = part.reshape(len(queries), BLOCK_DOCS, g.n_blocks).max(axis=1) + most[:, at : at + g.n_blocks]
            own = weight[:, column : column + g.long.shape[1]]
            at, column = at + g.n_blocks, column + g.long.shape[1]
            reach = (bound >= low[:, None]) & (bound > 0)
            self.blocks_read += int(reach.sum())
            some, blocks = np.flatnonzero(reach.any(axis=1)), np.flatnonzero(reach.any(axis=0))
            if not len(some):
                continue
            if 2 * len(blocks) < g.n_blocks:  # only the blocks that one of the queries needs
                places = (np.arange(BLOCK_DOCS)[:, None] * g.n_blocks + blocks).ravel()
                total = own[some] @ g.long[places].T
                total += part[some[:, None], places]
            else:
                places = np.arange(len(g.long))
                total = own[some] @ g.long.T
                total += part[some]
            row, found = np.nonzero(total >= np.maximum(low[some], np.finfo(np.float32).tiny)[:, None])
            cuts = np.searchsorted(row, np.arange(len(some) + 1))
            for r in np.unique(row).tolist():
                mine = found[cuts[r] : cuts[r + 1]]
                if len(mine) > 4 * k:  # fewer than these need to be exact
                    each = total[r, mine]
                    mine = mine[each >= np.partition(each, -k)[-k] * (1 - 2 * SLACK)]
                near[some[r]].append(g.begin + places[mine])
        return [self._best(*q, np.concatenate(found), k, floor) if found else (np.zeros(0), np.zeros(0, np.int64)) for q, found, floor in zip(queries, near, least, strict=True)]

    def _best(self, terms: np.ndarray, times: np.ndarray, found: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        full = self._exact(terms, times, found)
        keep = (full > 0) & (full >= least)
        full, found = full[keep], found[keep]
        best = np.lexsort((self.ids[found], -full))[:k]  # equal scores go to the lower id
        return full[best], found[best]

    def _opened(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the queries' lists add to each document where they aren't closed."""
        out = np.empty((len(queries), self.n), np.float32)
        for a in range(0, len(queries), FEW):
            few = queries[a : a + FEW]
            terms = np.concatenate([q[0] for q in few])
            row = np.repeat(np.arange(len(few)) * self.n, [len(q[0]) for q in few])
            first = self.starts[terms]
            size = self.starts[terms + 1] - first
            some = np.flatnonzero(size)
            row, first, size = row[some], first[some].astype(np.int64), size[some].astype(np.int64)
            posting = self.posting[spread(first, size)].view(np.uint32).reshape(-1, 2)
            gain = posting[:, 1].view(np.float32).astype(np.float64)
            times = np.concatenate([q[1] for q in few])[some]
            many = np.flatnonzero(times != 1)  # most stand once
            ends = np.cumsum(size)
            gain[spread((ends - size)[many], size[many])] *= np.repeat(times[many], size[many])
            at = np.repeat(row, size)
            at += posting[:, 0]
            out[a : a + FEW] = np.bincount(at, gain, len(few) * self.n).reshape(len(few), self.n)
        return out

    def _exact(self, terms: np.ndarray, times: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Scores of some documents in double precision, added up in the order of their terms."""
        self.asked[terms] = times * self.idf[terms]
        size = self.size[places]
        at = spread(self.first[places], size)
        tf = self.tf[at].astype(np.float64)
        gain = self.asked[self.term[at]] * tf * (K1 + 1) / (tf + np.repeat(self.norm[places], size))
        self.asked[terms] = 0
        return np.round(np.bincount(np.repeat(np.arange(len(places)), size), gain, len(places)), DECIMALS)


def _placed(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each word among the known ones, -1 if it isn't there."""
    if not len(known):
        return np.full(len(words), -1, np.int32)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, at, -1).astype(np.int32)


def alike(doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """Group of each of n documents by the common terms it has: a few rounds of k-means by cosine from centres far apart."""
    often = np.argsort(-np.bincount(term, minlength=1), kind="stable")[:GROUP_TERMS]
    slot = np.full(max(int(term.max(initial=0)) + 1, len(often)), -1, np.int32)
    slot[often] = np.arange(len(often))
    slot = slot[term]
    if not n or not len(term):
        return np.zeros(n, np.int64)
    has = np.zeros((n, len(often)), np.float32)
    has[doc[slot >= 0], slot[slot >= 0]] = 1
    has /= np.maximum(np.sqrt(has.sum(axis=1, keepdims=True)), 1)
    centres, nearest = has[np.argmax(has.any(axis=1))][None], np.full(n, -1.0)
    while len(centres) < min(GROUPS, n):
        nearest = np.maximum(nearest, has @ centres[-1])
        nearest[~has.any(axis=1)] = 2
        centres = np.append(centres, has[np.argmin(nearest)][None], axis=0)
    for _ in range(ROUNDS):
        group = np.argmax(has @ centres.T, axis=1)
        sums = np.stack([has[group == c].sum(axis=0) for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return group


def search(documents: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query, fewer if fewer share a term with it.

    Ids are integers; other types are refused. Equal scores (to DECIMALS places) go by doc_id, null first. Query rows with a null
    id, null and blank texts, and texts without a known term have no result; repeated queries are answered once (by their
    least text), repeated documents count as several. Texts are used whole; an empty table gives an empty result; other columns
    don't matter, whatever their names.
    """
    spark = documents.sparkSession
    for frame, name in ((documents, id_col), (queries, query_id)):
        if not isinstance(kind := frame.select(F.col(name).alias("id")).schema["id"].dataType, T.IntegralType):
            raise TypeError(f"{name} has to be an integer, not {kind.simpleString()}")
    asked = queries.where(F.col(query_id).isNotNull()).groupBy(F.col(query_id).cast("long").alias("q")).agg(F.min(query_text).alias("text"))
    asked = cut(packed_queries(asked), "queries")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    packed = cut(shards(documents, id_col, text_col, shard_docs), "shards")
    n, length, most = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    df = cut(frequencies(packed), "frequencies")
    lots = sorted(r["lot"] for r in packed.select("lot").collect())
    early = lots[::EARLY] if len(lots) > 1 else []
    out = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).orderBy("q").toArrow()  # about QUERY_BLOCK of them
        found = _search_block(spark, packed, query_block(rows), df, n, length / max(n, 1), k, max(1, math.ceil(math.sqrt(most))), early)
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(spark: SparkSession, packed: DataFrame, block: Queries, df: DataFrame, n: int, mean: float, k: int, fan: int, early: list[int]) -> DataFrame:
    """Shards `early` are searched first: a query's k-th best score there is what documents of the others have to reach."""
    found = known_frequencies(df, block)
    shared = spark.sparkContext.broadcast((block, np.log(1 + (n - found + 0.5) / (found + 0.5))))
    none = (np.zeros(0), np.zeros(0, np.int64))

    def row(pack: int, part: int, best: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
        cols = (np.array([len(b[0]) for b in best], np.int32), np.concatenate([b[0] for b in best]), np.concatenate([b[1] for b in best]))
        return [pa.array([pack], pa.int32()), pa.array([part], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)]

    names = ["pack", "part", "sizes", "scores", "ids"]

    floor = spark.sparkContext.broadcast(np.zeros(len(block.ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (q, idf), reached = shared.value, floor.value
        best = [none] * len(q.ids)
        for batch in batches:
            for r in range(batch.num_rows):
                index = Index(*(np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in enumerate(KINDS)), q.words, idf, mean)
                for at in range(0, len(q.ids), TOGETHER):
                    several = [(q.terms[a:b], q.times[a:b]) for a, b in zip(q.starts[at : at + TOGETHER], q.starts[at + 1 : at + 1 + TOGETHER], strict=False)]
                    least = np.array([had[-1] if len(had) == k else 0.0 for had, _ in best[at : at + TOGETHER]])
                    least = np.maximum(least, reached[at : at + TOGETHER])
                    for i, (score, place) in enumerate(index.several(several, *index.bounds(several), k, least), at):
                        if len(score):
                            had, ids = best[i]
                            best[i] = _best(np.concatenate([had, score]), np.concatenate([ids, index.ids[place]]), k)
        part = TaskContext.get().partitionId() % fan
        for at in range(0, len(q.ids), PACK):
            yield pa.RecordBatch.from_arrays(row(at // PACK, part, best[at : at + PACK]), names=names)

    def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, score, document) of the k best of each query of a pack, and the pack's number of queries."""
        parts = [tuple(np.frombuffer(table.column(c)[r].as_py(), t) for c, t in (("sizes", np.int32), ("scores", np.float64), ("ids", np.int64))) for r in range(table.num_rows)]
        which = np.concatenate([np.repeat(np.arange(len(p[0])), p[0]) for p in parts])
        score, doc = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        order = np.lexsort((doc, -score, which))
        which, score, doc = which[order], score[order], doc[order]
        keep = np.arange(len(which)) - np.searchsorted(which, which) < k
        return which[keep], score[keep], doc[keep], len(parts[0][0])

    def merge(table: pa.Table) -> pa.Table:
        which, score, doc, size = merged(table)
        ends = np.searchsorted(which, np.arange(size + 1))
        return pa.Table.from_arrays(row(table.column("pack")[0].as_py(), 0, [(score[a:b], doc[a:b]) for a, b in zip(ends, ends[1:], strict=False)]), names=names)

    def finish(table: pa.Table) -> pa.Table:
        which, score, doc, _ = merged(table)
        ids = shared.value[0].ids[table.column("pack")[0].as_py() * PACK :]
        rank = np.arange(len(which)) - np.searchsorted(which, which) + 1
        return pa.table({"query_id": ids[which], "rank": rank.astype(np.int32), "doc_id": pa.array(doc, mask=doc == NO_ID), "score": score})

    def kth(table: pa.Table) -> pa.Table:
        """k-th best score of each query of a pack, 0 if it has fewer."""
        which, score, _, size = merged(table)
        least = np.zeros(size)
        last = np.arange(len(which)) - np.searchsorted(which, which) == k - 1
        least[which[last]] = score[last]
        return pa.table({"pack": table.column("pack")[:1], "least": pa.array([least.tobytes()], pa.binary())})

    schema = "pack int, part int, sizes binary, scores binary, ids binary"
    kept = None
    if early:
        is_early = F.col("lot").isin(early)
        kept = cut(packed.where(is_early).select(*BLOBS).mapInArrow(run, schema), "early")
        reached = np.zeros(len(block.ids))
        for r in kept.groupBy("pack").applyInArrow(kth, "pack int, least binary").toLocalIterator():  # one number for each query
            least = np.frombuffer(r["least"])
            reached[r["pack"] * PACK : r["pack"] * PACK + len(least)] = least
        floor = spark.sparkContext.broadcast(reached)
        packed = packed.where(~is_early)
    others = packed.select(*BLOBS).mapInArrow(run, schema)
    kept = others if kept is None else kept.unionByName(others)
    return kept.groupBy("pack", "part").applyInArrow(merge, schema).groupBy("pack").applyInArrow(finish, "query_id bigint, rank int, doc_id bigint, score double")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50 as a query, against all documents."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(documents, documents.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"))
