"""Codes of vectors by parts, with codebooks fitted exactly in whole numbers; nearest entries by slice-and-intersect bitmasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, stable
from .vectors import matrix, packed, unpacked, whole_vectors

#: Digits in which sums of any size leave a task.
LIMB = 60


def number_kind(largest: float, dim: int) -> type:
    """The narrowest kind whose squared distances can't overflow: Python's integers where 64 bits are too few."""
    reach = 4 * largest * largest * max(1, dim)
    return np.int32 if reach < 2.0**31 else np.int64 if reach < 2.0**62 else object


def _as(x: np.ndarray, kind: type) -> np.ndarray:
    if kind is object and x.dtype != object:
        return np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object)
    return x.astype(kind)


class Slices:
    """Entries sorted along each dimension, with a mask of those before each place.

    The entries between two places of a dimension are the difference of two masks; those in a cube
    around a query are the AND over all dimensions, 64 entries to a word. A query's nearest entry is
    certain once the cube's half side reaches the distance of the best entry in it.
    """

    def __init__(self, entries: np.ndarray) -> None:
        self.entries, (m, dims) = entries, entries.shape
        self.words = -(-m // 64)
        one = np.zeros((m, self.words), np.uint64)
        one[np.arange(m), np.arange(m) // 64] = np.uint64(1) << (np.arange(m) % 64).astype(np.uint64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        self.before = np.zeros((dims, m + 1, self.words), np.uint64)
        for j in range(dims):
            self.before[j, 1:] = np.bitwise_or.accumulate(one[order[:, j]], axis=0)
        # the side of a cube that holds another entry for half of the entries
        apart = [int(np.sort(np.abs(entries - e).max(axis=1))[1]) for e in entries] if m > 1 and dims else [0]
        self.start = sorted(apart)[len(apart) // 2]

    def within(self, q: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries in the cubes of half side radius around the rows of q."""
        out = np.broadcast_to(self.before[0, -1] if len(self.before) else np.zeros(0, np.uint64), (len(q), self.words)).copy()
        for j, (values, before) in enumerate(zip(self.sorted.T, self.before, strict=True)):
            low = np.searchsorted(values, q[:, j] - radius, "left")
            high = np.searchsorted(values, q[:, j] + radius, "right")
            out &= before[high] ^ before[low]
        return out

    def _best(self, q: np.ndarray, masks: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        """Betters best and at by the entries in masks; of equals the lower index."""
        for w in np.flatnonzero(np.bitwise_or.reduce(masks, axis=0)).tolist():
            left = int(np.bitwise_or.reduce(masks[:, w]))
            for b in range(64):
                if left >> b & 1:
                    e = 64 * w + b
                    rows = np.flatnonzero(masks[:, w] >> np.uint64(b) & np.uint64(1))
                    d = q[rows] - self.entries[e]
                    d = (d * d).sum(axis=1) if d.dtype == object else np.einsum("ij,ij->i", d, d)
                    old = best[rows]
                    new = (at[rows] < 0) | (d < old) | ((d == old) & (e < at[rows]))
                    best[rows[new]], at[rows[new]] = d[new], e

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry."""
        best, at = np.zeros(len(q), q.dtype), np.full(len(q), -1, np.int64)
        if not q.shape[1]:
            return np.zeros(len(q), np.int64), best
        seen, left = np.zeros((len(q), self.words), np.uint64), np.arange(len(q))
        radius = np.full(len(q), max(1, self.start), q.dtype)
        while len(left):
            masks = self.within(q[left], radius[left])
            new, b, a = masks & ~seen[left], best[left], at[left]
            self._best(q[left], new, b, a)
            best[left], at[left], seen[left] = b, a, seen[left] | masks
            # the root, rounded up: a cube of this side holds every entry that is as near
            need = np.array([isqrt(v) + 1 for v in b.tolist()], object) if b.dtype == object else np.ceil(np.sqrt(b) * (1 + 1e-12)).astype(b.dtype)
            far = a < 0
            again = far | (need > radius[left])
            radius[left] = np.where(far, radius[left] * 2, need)
            left = left[again]
        return at, best


def _cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts of equal length; where dim is no multiple, the first ones are longer by one."""
    ends = np.cumsum([dim // parts + (i < dim % parts) for i in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _limbs(value: int) -> list[int]:
    """value as signed digits of LIMB bits, at least one."""
    out, sign, value = [], -1 if value < 0 else 1, abs(int(value))
    while value or not out:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def _assigned(blocks: DataFrame, dim: int, books: list[np.ndarray], kind: type) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (vectors that have it as their nearest, their exact sums). Tasks add up their own; the sums are added by place."""
    cuts = _cuts(dim, len(books))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        wide = object if kind is object else np.int64
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, wide) for b in books]
        for x in unpacked(batches, dim):
            for p, (a, b) in enumerate(cuts):
                q = _as(x[:, a:b], kind)
                at, _ = slices[p].nearest(q)
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                count[p][used] += np.diff([*first, len(at)])
                total[p][used] += np.add.reduceat(q[order].astype(wide), first, axis=0)
        rows = [(p, e, -1, 0, int(n)) for p, c in enumerate(count) for e, n in enumerate(c.tolist()) if n]
        for p, e, _, _, _ in list(rows):
            rows += [(p, e, j, limb, v) for j, s in enumerate(total[p][e].tolist()) for limb, v in enumerate(_limbs(s))]
        names = ["part", "entry", "place", "limb", "v"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names)

    sums = blocks.mapInArrow(add, "part long, entry long, place long, limb long, v long").groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = {}
    for r in sums.collect():
        key = r["part"], r["entry"]
        a, b = cuts[key[0]]
        own = out.setdefault(key, [0, [0] * (b - a)])
        if r["place"] < 0:
            own[0] = int(r["v"])
        else:
            own[1][r["place"]] += int(r["v"]) << (LIMB * r["limb"])
    return out


def codebooks(x: DataFrame, dim: int, rows: int, kind: type, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """One book for each part: begun with the vectors of the `entries` smallest ids, then `rounds` times the floors of their parts' means.

    x has vec_id and `__x`, some `rows` rows. Rows that repeat an id follow each other by their vectors; null ids come last.
    """
    first = x.select("vec_id", "__x").orderBy(F.col("vec_id").asc_nulls_last(), "__x").limit(entries).collect()
    start = _as(np.array([r["__x"] for r in first]).reshape(-1, dim), kind)
    books = [start[:, a:b] for a, b in _cuts(dim, parts)]
    blocks = packed(x, dim, rows)
    for _ in range(rounds if len(start) else 0):
        books = [b.copy() for b in books]
        for (p, e), (n, sums) in _assigned(blocks, dim, books, kind).items():
            books[p][e] = [s // n for s in sums]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' numbers by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 1024
) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that takes part.

    Components become floor(scale * x), exact at any size. code: the index of each part's nearest
    entry (ties: the lower), two hex digits each; error: their squared distances together;
    label_error: the errors of all rows of that label together, nulls as one label. An error that no long
    holds is null, and so is the sum of its label. Rows are left out whose vector is null, has null
    or non-finite components, or has another length than most. Fewer rows than entries: as many
    entries. Repeated rows count each; an empty table gives no rows. entries: 256 at most.

    Each round is one pass over written blocks; a task hands on one sum for each number of
    the books, so nothing that grows with the table meets in one place.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    x, dim, largest, rows = whole_vectors(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("__label"), F.col(vector_col).alias("__v")), "__v", scale)
    kind = number_kind(largest, dim)
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if dim == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    books, cuts = codebooks(x, dim, rows, kind, parts, entries, rounds), _cuts(dim, parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for b in batches:
            m = matrix(b.column("__x"), dim)
            index, error = np.zeros((len(m), parts), np.uint8), np.zeros(len(m), object if kind is object else np.int64)
            for p, (first, end) in enumerate(cuts):
                at, d = slices[p].nearest(_as(m[:, first:end], kind))
                index[:, p] = at
                error += d
            code = [row.tobytes().hex() for row in index]
            held = pa.array([e if e < 2**63 else None for e in error.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("__key"), pa.array(code), held], ["vec_id", "__key", "code", "error"])

    # equal labels have equal keys of bounded length, nulls one of their own
    label = F.col("__label").cast("string")
    key = F.coalesce(F.when(F.length(label) <= 64, F.concat(F.lit("="), label)).otherwise(F.sha2(label.cast("binary"), 256)), F.lit(""))
    coded = stable(x.withColumn("__key", key).select("vec_id", "__key", "__x").mapInArrow(encode, "vec_id long, __key string, code string, error long"))
    total = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")))
    fits = F.when(total <= F.lit(2**63 - 1).cast("decimal(38,0)"), total).cast("long")
    labels = stable(coded.groupBy("__key").agg(fits.alias("label_error"), F.count(F.lit(1)).alias("__n")))
    out = by_size(coded, labels, "__key", "__n", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
