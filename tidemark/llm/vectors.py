"""Vectors of whole numbers, and blocks of them that passes read without unpacking rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stable

#: Bytes of a block at most, counted at 8 bytes an entry (one vector at least).
BLOCK_BYTES = 1 << 22
#: Entries that a partition of blocks has at least, where there are as many: passes over few vectors need few tasks.
PART_ENTRIES = 1 << 19


def whole_vectors(df: DataFrame, vector_col: str, scale: int) -> tuple[DataFrame, int, float, int]:
    """(df with `__x`, the vectors' length, largest size of an entry, number of rows).

    `__x` holds floor(scale * c) of every entry c, in the narrowest of smallint, int and double (which
    holds every floor of a large double). Rows are left out whose vector is null, holds null or
    non-finite entries, or whose length is not the table's commonest one (of equally common
    ones the longest). Without rows the length is 0.
    """
    x = F.transform(F.col(vector_col), lambda c: F.lit(float(scale)) * c.cast("double"))
    # floor gives a long; a double of 2**53 or more has no fraction
    ints = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = df.where(F.col(vector_col).isNotNull()).where(fine).withColumn("__x", ints)
    size = kept.groupBy(F.size("__x").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("__x", F.abs))).alias("largest"))
    found = size.orderBy(F.desc("n"), F.desc("dim")).first()
    dim, largest, n = (found["dim"], found["largest"] or 0.0, found["n"]) if found else (0, 0.0, 0)
    kind = "array<smallint>" if largest < 2**15 else "array<int>" if largest < 2**31 else "array<double>"
    return kept.where(F.size("__x") == dim).withColumn("__x", F.col("__x").cast(kind)), dim, largest, n


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def partition_count(rows: int, dim: int) -> int:
    """Partitions of blocks at most."""
    return max(1, -(-rows * dim // PART_ENTRIES))


def packed(x: DataFrame, dim: int, rows: int) -> DataFrame:
    """(n, kind, data): blocks of the vectors in `__x`, some `rows` of them, written once. `unpacked` reads them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_BYTES // (8 * dim))
        for b in batches:
            rows = matrix(b.column(0), dim)
            parts = [rows[a : a + step] for a in range(0, len(rows), step)]
            kinds = [p.dtype.str for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(map(len, parts), pa.int64()), pa.array(kinds), pa.array([p.tobytes() for p in parts], pa.binary())], ["n", "kind", "data"])

    return stable(x.select("__x").coalesce(partition_count(rows, dim)).mapInArrow(pack, "n long, kind string, data binary"))


def unpacked(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for b in batches:
        for kind, data in zip(b.column("kind").to_pylist(), b.column("data"), strict=True):
            yield np.frombuffer(data.as_buffer(), np.dtype(kind)).reshape(-1, dim)
