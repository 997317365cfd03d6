"""Order-dependent folds over each key's rows, as one pass over a task's sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that a fold gathers before it hands them on.
ROWS = 10_000


def fold_keys(rows: DataFrame, keys: Iterable[str], order: str, fold: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """rows through fold, an iterator over a task's batches: all rows of a key follow each other, in the order given.

    A key may begin in one batch and end in another. No key's rows are gathered and nothing is made for each key, so many small
    keys cost what their rows do and a large one needs no memory but the fold's own.
    """
    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(fold, schema)


def columns_of(batch: pa.RecordBatch, names: Iterable[str]) -> Iterator[tuple]:
    """The batch's rows as tuples of the named columns."""
    return zip(*[batch.column(n).to_pylist() for n in names], strict=True)
