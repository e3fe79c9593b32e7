"""Rows of each key in one pass over sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

#: Rows that are handed on at once, and bytes, at about.
ROWS, BYTES = 1 << 13, 1 << 23


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows` at most."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def _edges(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Places of rows whose key is not that of the row before, the first one among them."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        code = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, its rows) of batches in which rows of one key follow one another."""
    held: list[pa.RecordBatch] = []
    at: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        begin = _edges(b, keys)
        named = list(zip(*(b.column(k).take(pa.array(begin)).to_pylist() for k in keys), strict=True))
        for key, a, z in zip(named, begin.tolist(), [*begin[1:].tolist(), b.num_rows], strict=True):
            if held and key != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = key
            held.append(b.slice(a, z - a))
    if held:
        yield at, pa.Table.from_batches(held)


def by_key(df: DataFrame, keys: list[str], order: list[str | Column], run: Callable[[tuple, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """What run gives for the rows of each key, in their order.

    Like a grouped map, but a task streams through its keys: it holds one key's rows and some results, and a
    key costs no frame of its own, so many small keys are cheap. run must return columns of the schema's names and types.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[pa.RecordBatch] = []
        rows = size = 0
        for key, part in groups(batches, keys):
            got = run(key, part)
            made.append(got)
            rows, size = rows + got.num_rows, size + got.nbytes
            if rows >= ROWS or size >= BYTES or len(made) >= ROWS:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                made, rows, size = [], 0, 0
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)
