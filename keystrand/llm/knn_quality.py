"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text is counted in four blocks of features: token shapes, pairs of neighbouring shapes, repetition, and hashed words; each
block is scaled to a fixed share. The labelled sample's vectors are reduced by a truncated singular value decomposition and
broadcast (their number and width are bounded). Every document is folded into that space, the exact cosine to all labelled
vectors is computed as blocked matrix products, and the labels of the nearest ones vote by similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled texts whose vectors are kept and broadcast, at most (MAX_FIT_ROWS x RANK floats).
MAX_FIT_ROWS = 5_000
RANK = 64
NEIGHBOURS = 15
#: Exponent of the similarity in a vote.
SHARPNESS = 8
SHAPES, PAIRS, WORDS = 256, 512, 512
REPEATS = 6
WIDTH = SHAPES + PAIRS + WORDS + REPEATS
#: Share of each block in the squared length of a vector.
SHARES = (0.35, 0.2, 0.1, 0.35)
#: Cosines that differ by less are equal: rounding of the products depends on the shape of a block.
TIE = 1e-6
#: Documents in a block of the products.
BLOCK = 512


def shape_of(token: str) -> str:
    """Character classes of a token, runs as one: upper U, lower l, digit d, others themselves."""
    out = []
    for c in token:
        k = "U" if c.isupper() else "l" if c.isalpha() else "d" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:8])


class Features:
    """Feature vectors of texts; remembers the codes of tokens, up to a bound."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}

    def code(self, token: str) -> int:
        """shape * WORDS + word"""
        word = zlib.crc32(token.lower().strip(".,;:!?*#$%&|'\"()").encode("utf-8", "surrogatepass")) % WORDS
        return zlib.crc32(shape_of(token).encode("utf-8", "surrogatepass")) % SHAPES * WORDS + word

    def vector(self, text: str | None) -> np.ndarray:
        out = np.zeros(WIDTH, np.float32)
        tokens = (text or "").split()
        n = len(tokens)
        if not n:
            return out
        codes = self.codes
        try:
            found = [codes[t] for t in tokens]
        except KeyError:
            if len(codes) > 400_000:
                codes.clear()
            for t in tokens:
                if t not in codes:
                    codes[t] = self.code(t)
            found = [codes[t] for t in tokens]
        code = np.array(found, np.int64)
        shape = code // WORDS
        pair = (shape[:-1] * 31 + shape[1:] * 17) % PAIRS
        again = sum(map(eq, tokens, tokens[1:])) / max(1, n - 1)
        second = sum(map(eq, tokens, tokens[2:])) / max(1, n - 2)
        letters = sum(map(str.isupper, tokens)) / n
        blocks = (
            np.bincount(shape, minlength=SHAPES),
            np.bincount(pair, minlength=PAIRS) if n > 1 else np.zeros(PAIRS),
            np.bincount(code % WORDS, minlength=WORDS),
            np.array([again, 1 - again, second, 1 - second, letters, 1 - letters]),
        )
        at = 0
        for block, share in zip(blocks, SHARES, strict=True):
            root = np.sqrt(block)
            length = np.sqrt((root * root).sum())
            if length:
                out[at : at + len(block)] = root * (np.sqrt(share) / length)
            at += len(block)
        return out


@dataclass
class Model:
    """basis: WIDTH x rank; vectors: labelled unit vectors, rows x rank; votes: their labels; prior: share of label 1."""

    basis: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    prior: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors, for each row; all that are as near as the last
        of them vote too, so their order doesn't matter."""
        if not len(self.votes):
            return np.full(len(features), self.prior)
        folded = _unit(features @ self.basis)
        out = np.empty(len(features))
        k = min(NEIGHBOURS, len(self.votes))
        for at in range(0, len(features), BLOCK):
            cosine = folded[at : at + BLOCK] @ self.vectors.T
            last = np.partition(cosine, len(self.votes) - k, axis=1)[:, len(self.votes) - k]
            row, near = np.nonzero(cosine >= last[:, None] - TIE)
            weight = np.clip(cosine[row, near], 0, None).astype(np.float64) ** SHARPNESS
            votes = self.votes[near]
            weight *= np.where(votes > 0.5, 1.0, self.prior / max(1e-6, 1 - self.prior))  # the rarer label's votes count for more
            total = lambda w, n=len(cosine): np.bincount(row, w, minlength=n)  # noqa: B023, E731
            out[at : at + BLOCK] = (total(weight * votes) + 1e-3 * self.prior) / (total(weight) + 1e-3)
        return np.where(np.abs(features).sum(1) > 0, out, 0.0)  # a text without tokens has no neighbours and no use


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(labelled: DataFrame, label: str = "quality", rank: int = RANK) -> Model:
    """Model from rows (text, label 0/1), whose number has to be bounded by the caller (MAX_FIT_ROWS); null labels are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for batch in batches:
            rows = [made.vector(x).astype(np.float16).tobytes() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1).cast(pa.float64())], names=["v", "y"])

    table = labelled.where(F.col(label).isNotNull()).select("text", label).mapInArrow(run, "v binary, y double").orderBy("v", "y").toArrow()
    votes = np.asarray(table.column("y"), dtype=np.float64)
    if not len(votes):
        return Model(np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), votes, 0.5)
    x = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)
    values, axes = np.linalg.eigh(x.T @ x)
    basis = np.ascontiguousarray(axes[:, ::-1][:, : min(rank, len(votes))]).astype(np.float32)
    return Model(basis, np.ascontiguousarray(_unit(x @ basis)), votes, float(votes.mean()))


def score(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of `documents` but the text, plus score (0 to 1).

    Only the text is looked at, whole. Null and blank texts score 0. Labelled vectors as near as the last neighbour all vote.
    Repeated rows score alike; a column named score is replaced.
    """
    keep = [f for f in documents.schema.fields if f.name not in (text_col, "score")]
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType())])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for batch in batches:
            texts = batch.column(len(keep))
            parts = [
                shared.value.scores(np.stack([made.vector(x.as_py()) for x in texts.slice(at, BLOCK)]))
                for at in range(0, len(texts), BLOCK)
            ]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.clip(scores, 0, 1), pa.float64())], names=schema.names)

    return documents.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text_col}`")).mapInArrow(run, schema)
